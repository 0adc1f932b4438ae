"""Token counts by trie-shared dynamic programming.

A pre-token is a word with a mark for the space before it. Its tokens are the segmentation of the highest summed log probability under a
unigram model whose pieces are those of a public vocabulary (never trained here) and whose probabilities fall with a piece's rank by
Zipf's law; of equal sums the segmentation of fewer tokens wins. Characters without a piece cost their UTF-8 bytes. Distinct pre-tokens
are inserted in a trie; a node's best forward score is computed when it is made, from its ancestors', so each shared prefix is scored once, and
the count of a pre-token is read at its terminal node. A worker's trie is dropped and begun anew at NODES nodes, and a pre-token of over LONG bytes
is scored by the same steps over the last scores alone, without nodes; both bound memory and change no count.

Null, empty and white texts have 0 words and tokens. Rows that repeat are counted each. Other columns are not read. The vocabulary is read
on the driver and broadcast (some 32,000 pieces)."""

from __future__ import annotations

import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NODES, LONG = 1_000_000, 256
SPACE = "▁"


def vocabulary(path: str = MODEL) -> dict[str, float]:
    """Pieces with their log probabilities: the n-th of the file has a probability in proportion to 1 / (n + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return zipf(pieces)


def zipf(pieces: list[str]) -> dict[str, float]:
    norm = math.log(sum(1 / (n + 1) for n in range(1, len(pieces) + 1)))
    found: dict[str, float] = {}
    for n, p in enumerate(pieces, 1):
        found.setdefault(p, -math.log(n + 1) - norm)
    return found


class Trie:
    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.scores, self.most = scores, nodes
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0  # of each byte of a character without a piece
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("l", [0])
        self.words: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """The terminal node of a pre-token; nodes on the way that are new get their forward score."""
        path, node = [0], 0
        for i, c in enumerate(word):
            key = node << 21 | ord(c)
            at = self.child.get(key)
            if at is None:
                at = self.child[key] = len(self.best)
                size = len(c.encode("utf-8", "surrogatepass"))
                best, count = self.best[node] + self.byte * size, self.count[node] + size
                end = i + 1
                for start in range(i, max(-1, i - self.longest), -1):
                    s = self.scores.get(word[start:end])
                    if s is not None:
                        from_ = path[start]
                        total, n = self.best[from_] + s, self.count[from_] + 1
                        if total > best + 1e-9 or (total > best - 1e-9 and n < count):
                            best, count = total, n
                self.best.append(best)
                self.count.append(count)
            node = at
            path.append(node)
        return node

    def rolled(self, word: str) -> int:
        """The count of a word of any length, from the scores of its last `longest` prefixes."""
        bests, counts, dropped = [0.0], [0], 0
        for i, c in enumerate(word):
            size = len(c.encode("utf-8", "surrogatepass"))
            best, count = bests[-1] + self.byte * size, counts[-1] + size
            for start in range(i, max(-1, i - self.longest), -1):
                s = self.scores.get(word[start : i + 1])
                if s is not None:
                    total, n = bests[start - dropped] + s, counts[start - dropped] + 1
                    if total > best + 1e-9 or (total > best - 1e-9 and n < count):
                        best, count = total, n
            bests.append(best)
            counts.append(count)
            if len(bests) > 1024 + self.longest:
                dropped += 1024
                del bests[:1024], counts[:1024]
        return counts[-1]

    def tokens(self, word: bytes) -> int:
        if len(word) > LONG:
            return self.rolled(SPACE + word.decode("utf-8", "surrogatepass"))
        n = self.words.get(word)
        if n is None:
            if len(self.best) > self.most:
                self.clear()
            n = self.words[word] = self.count[self.insert(SPACE + word.decode("utf-8", "surrogatepass"))]
        return n


def counted(scores: dict[str, float]):
    def run(batches):
        trie = Trie(scores.value if hasattr(scores, "value") else scores)
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                tokens.append(sum(map(trie.tokens, found)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, scores: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens): a row for each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    rows = docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text")
    return rows.mapInArrow(counted(shared), "doc_id bigint, n_words bigint, n_tokens bigint")


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
