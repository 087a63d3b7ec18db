"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are counted in time linear in its bytes, without building the pieces: a trie
of the vocabulary gets failure links, and each node knows how many pieces are popped when its link is taken.

The vocabulary is a file of byte pieces (base64 and rank on each line). Pieces with a leading blank start a word, pieces
without any white space may start at any later place; a word is matched as a blank and its bytes. Words are the maximal
runs of anything but ASCII white space. A byte that no piece starts with makes the word one unknown token.

Defined cases: null and empty texts have no words and no tokens; very long words and texts are counted whole; repeated
rows are counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a task remembers; the memory is dropped when it is full.
REMEMBERED = 200_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The usable pieces of a rank file: no white space but for one leading blank."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return [p for p in pieces if p and (p[:1] == b" " or not p[:1].isspace()) and (p[1:] == b"" or p[1:].split() == [p[1:]])]


class LongestMatch:
    """The automaton. ``step[node << 8 | byte]`` is the trie; ``fail`` and ``popped`` belong to the nodes; -1: no link."""

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}
        token = [False]
        parent = [(0, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in step:
                    step[key] = len(token)
                    token.append(False)
                    parent.append((node, byte))
                node = step[key]
            token[node] = True
        fail, popped = [-1] * len(token), [0] * len(token)
        children: list[list[int]] = [[] for _ in token]
        for node in range(1, len(token)):
            children[parent[node][0]].append(node)
        level = children[0]
        while level:  # breadth first: the links of a node come from shorter strings
            for node in level:
                if token[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                above, byte = parent[node]
                at, count = fail[above], popped[above]
                while at >= 0 and (at << 8 | byte) not in step:
                    count += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], popped[node] = step[at << 8 | byte], count
            level = [child for node in level for child in children[node]]
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a blank and the word; -1 if the word can't be matched."""
        step, fail, popped = self.step.get, self.fail, self.popped
        node = total = 0
        for byte in b" " + word:
            then = step(node << 8 | byte)
            while then is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                then = step(node << 8 | byte)
            node = then
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total if node == 0 else -1


class _Counts(dict):
    """Counts of the words seen so far, filled by the automaton; one entry has tokens and unknown words packed."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        n = 1 + (1 << 40) if n < 0 else n
        self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens, n_unknown) of every row. The vocabulary, a file of fixed size, is read on
    the driver and broadcast as its pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(LongestMatch(shared.value))
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                data = text.as_py() or b""
                words = data.split()
                total = sum(map(counts.__getitem__, words))
                rows.append((len(data), len(words), total & ((1 << 40) - 1), total >> 40))
                if len(counts) > REMEMBERED:
                    counts.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_words long, n_tokens long, n_unknown long")
