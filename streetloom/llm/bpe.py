"""Exact BPE encoding in linear time by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens walks a word once and gives the longest token at each place where the last
one ended. The encoder takes these from left to right as long as each is compatible with the one before it. Where one
is not, it takes the next shorter token; where none fits, it marks the place as dead, steps back, and starts the
automaton again at the place it goes on from; every place dies once at most. Two tokens are compatible if merging their
joined text gives just these two; that is read off their merge trees, and the answers make a table that fills as pairs
turn up. A path whose neighbouring pairs are all compatible is the very result of applying the merges by rank.

White space ends every word, so blocks without white space are encoded alone, and a bounded table keeps frequent ones.

Decoding: the written forms of all tokens lie in one string, with a table of offsets; the decoded text joins their
slices by one space each, as the library does for vocabularies without a decoder.

Edge cases: null counts as empty; empty texts give no ids and an empty decoded text; texts of any length go through
whole; repeated rows are encoded each for itself; an empty table gives an empty result; other columns pass through,
but one named like the output is replaced.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, with_fields
from .vocab import Recent, Specials, Vocabulary, blocks, pieces, symbols

#: Blocks that a worker remembers before it starts anew.
KEPT_BLOCKS = 1 << 18
#: Symbols that the automaton is given at once: starting it costs what it is given.
SPAN = 1024
#: Longer ones are not remembered.
LONGEST_KEPT = 64


class Encoder:
    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT_BLOCKS):
        import ahocorasick

        self.special = Specials(vocabulary.special)
        self.length = {i: len(s) for s, i in vocabulary.ids.items()}
        self.most = max(self.length.values(), default=0)
        if 2 * self.most > SPAN:
            raise ValueError("tokens longer than the automaton sees at once")
        self.automaton = ahocorasick.Automaton()
        for s, i in vocabulary.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(vocabulary.merges)}
        self.born = {c: k for k, (_, _, c) in enumerate(vocabulary.merges)}
        self.parts = {c: (a, b) for a, b, c in vocabulary.merges}
        self.shorter: dict[int, int | None] = {}
        ids = vocabulary.ids
        for s in ids:
            self.shorter[ids[s]] = next((ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in ids), None)
        self.spines: tuple[dict, dict] = ({}, {})
        self.table: dict[int, bool] = {}
        self.blocks, self.words = Recent(kept), Recent(kept)
        #: Answers about pairs that are remembered.
        self.kept_pairs = 2 * kept

    def _spine(self, token: int, side: int) -> tuple[list[int], list[float]]:
        """The tokens along one edge of a merge tree from the root down, and the ranks at which each is used up."""
        if (known := self.spines[side].get(token)) is None:
            out, dies, at, rank = [], [], token, float("inf")
            while True:
                out.append(at)
                dies.append(rank)
                if at not in self.parts:
                    break
                at, rank = self.parts[at][side], self.born[at]
            known = self.spines[side][token] = (out, dies)
        return known

    def compatible(self, left: int, right: int) -> bool:
        key = (left << 20) | right
        known = self.table.get(key)
        if known is None:
            (a, a_dies), (b, b_dies) = self._spine(left, 1), self._spine(right, 0)
            i, j, rank, known = len(a) - 1, len(b) - 1, self.rank.get, True
            while True:  # from the first merge on: which two tokens meet at the boundary, and is their own merge next
                x, y = a_dies[i], b_dies[j]
                r = rank((a[i], b[j]))
                if r is not None and r < x and r <= y:  # at equal ranks the leftmost merge goes first
                    known = False
                    break
                if x == y == float("inf"):
                    break
                if x <= y:
                    i -= 1
                else:
                    j -= 1
            if len(self.table) > self.kept_pairs:
                self.table.clear()
            self.table[key] = known
        return known

    def word(self, word: str) -> list[int]:
        """Ids of one word of symbols."""
        walk, length, shorter, table = self.automaton.iter_long, self.length, self.shorter, self.table
        out: list[int] = []
        dead: set[int] = set()
        size, at, last, most = len(word), 0, -1, self.most
        tokens, stop = walk(word[:SPAN] if size > SPAN else word), min(size, SPAN)
        token = next(tokens)[1]
        while True:
            end = at + length[token]
            fits = last < 0
            if not fits and (fits := table.get((last << 20) | token)) is None:
                fits = self.compatible(last, token)
            if fits and end not in dead:
                out.append(token)
                if end == size:
                    return out
                at, last = end, token
                # the automaton was left for a shorter token, or a token may go on beyond what it sees: it starts again here
                if tokens is None or (at + most > stop and stop < size):
                    stop = min(size, at + SPAN)
                    tokens = walk(word[at:stop])
                token = next(tokens)[1]
            elif (less := shorter[token]) is not None:
                token, tokens = less, None
            else:
                dead.add(at)
                token, tokens = out.pop(), None
                at -= length[token]
                last = out[-1] if out else -1

    def block(self, block: str) -> bytes:
        """Ids of a block, as 32-bit numbers."""
        if (packed := self.blocks.get(block)) is None:
            made = []
            for part, special in self.special.cut(block):
                if special is not None:
                    made.append(array("i", [special]).tobytes())
                    continue
                for word in pieces(part):
                    if (ids := self.words.get(word)) is None:
                        ids = array("i", self.word(symbols(word))).tobytes()
                        if len(word) <= LONGEST_KEPT:
                            self.words.put(word, ids)
                    made.append(ids)
            packed = b"".join(made)
            if len(block) <= LONGEST_KEPT:
                self.blocks.put(block, packed)
        return packed

    def encode(self, text: str | None) -> array:
        parts = blocks(text or "")
        found = list(map(self.blocks.new.get, parts))
        if None in found:
            find = self.block
            found = [find(b) if x is None else x for x, b in zip(found, parts)]
        out = array("i")
        out.frombytes(b"".join(found))
        return out


class Decoder:
    """All written tokens in one string, each followed by a space, and where each begins and ends."""

    def __init__(self, vocabulary: Vocabulary):
        n = max(vocabulary.written) + 1
        self.offsets, parts, at = array("q", [0]), [], 0
        for i in range(n):
            parts.append(vocabulary.written.get(i, "") + " ")
            at += len(parts[-1])
            self.offsets.append(at)
        self.text = "".join(parts)
        #: Slices by id; made once from the offset table.
        self.slices = [self.text[a:b] for a, b in zip(self.offsets, self.offsets[1:])]

    def decode(self, ids) -> str:
        return "".join(map(self.slices.__getitem__, ids))[:-1]


_MADE: dict = {}
#: Encoders, decoders and transducers that a worker holds at once.
KEPT_MADE = 3


def _of(shared, kind, *sizes):
    """One encoder or decoder for each worker process and vocabulary."""
    key = (kind.__name__, shared.path, shared.id, *sizes)
    if key not in _MADE:
        if len(_MADE) >= KEPT_MADE:  # other vocabularies or sizes have had their turn
            _MADE.clear()
        _MADE[key] = kind(shared.value.value, *sizes)
        # what was made holds all it needs; the broadcast's own copy can be loaded again
        vars(shared.value).pop("_value", None)
    return _MADE[key]


class Shared:
    """A vocabulary read on the driver (executors need no such file) and broadcast; its size is that of one file."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.id = path, spark.sparkContext.applicationId
        self.value = spark.sparkContext.broadcast(Vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids", decoded: str | None = None, kept: int = KEPT_BLOCKS) -> DataFrame:
    """``docs`` and a column of token ids (array<int>); with ``decoded``, also the text that these ids give. A worker
    remembers ``kept`` blocks at most: fewer take less memory and more time, and give the same ids."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = Shared(spark, path or default_path())
    docs = docs.drop(out, *([decoded] if decoded else []))
    extra = [(out, "array<int>"), *([(decoded, "string")] if decoded else [])]

    def run(batches):
        encoder, decoder = _of(shared, Encoder, kept), _of(shared, Decoder)
        for batch in batches:
            flat, offsets, texts = array("i"), array("i", [0]), []
            for t in batch.column(text):
                ids = encoder.encode(t.as_py())
                flat.extend(ids)
                offsets.append(len(flat))
                if decoded:
                    texts.append(decoder.decode(ids))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32()))
            batch = batch.append_column(out, ids.cast(pa.list_(pa.int32())))
            yield batch.append_column(decoded, pa.array(texts, pa.string())) if decoded else batch

    return docs.mapInArrow(run, with_fields(docs, *extra))


def decode(frame: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` and the text that the ids in column ``ids`` give; null ids give null."""
    spark = frame.sparkSession
    arrow_batches(spark)
    shared = Shared(spark, path or default_path())

    frame = frame.drop(out)

    def run(batches):
        decoder = _of(shared, Decoder)
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(ids).to_pylist()]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return frame.mapInArrow(run, with_fields(frame, (out, "string")))


def digests(frame: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = encode(documents(spark, sf_dir).select("doc_id", "text"), decoded="decoded")
    return frame.select("doc_id", *digests(frame))


__all__ = ["Decoder", "Encoder", "decode", "default_path", "encode", "query"]
