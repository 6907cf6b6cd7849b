"""Token counts by a compiled finite-state transducer whose transitions carry the number of tokens they emit.

State: what the merges can still see of a word - the longest suffix from which a token may still go on, and for each
such place in it the last token of the encoding up to there and its count, relative to now. Reading one symbol gives the
next state and the change of the token count; both are found once by comparing candidate tokens through the
pair-compatibility table and are then a transition of a deterministic transducer. The symbol that ends a word leads to
the start state. States are numbered and compiled as they turn up; when they outgrow ``KEPT_STATES``, also inside a
word, the tables start anew from the state reached (results do not change). Words and blocks seen before are
transitions from start state to start state.

Every text is a row of chunks, ``BLOCKS`` blocks or ``CHUNK`` symbols of a longer block, cut wherever that comes to lie,
inside words too. A chunk's map takes states to (state, tokens emitted). What state a chunk inside a word is entered in
is not known where it is mapped; its map holds the states that the symbols before it lead to from ``LOOKBACKS`` places,
and one that is asked for later is run and added, so maps are exact for every state. Maps compose associatively, and a
prefix scan in pairs gives the tokens up to the end of every chunk (column ``offsets`` of ``token_counts``), the last of
which is the count of the text.

Edge cases: null counts as empty: 0 bytes, 0 tokens; texts and words of any length are read whole, in chunks; repeated
rows are counted each for itself; an empty table gives an empty result; other columns pass through,
but those named like the output are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import KEPT_BLOCKS, LONGEST_KEPT, Encoder, Shared, _of, default_path
from .common import arrow_batches, documents, with_fields
from .vocab import Recent, Vocabulary, blocks, pieces, symbols

KEPT_STATES = 1 << 17
#: Symbols of a chunk inside a block, and blocks of a chunk of shorter ones.
CHUNK, BLOCKS = 4096, 1024
#: How far before a chunk inside a word its likely entry states are sought.
LOOKBACKS = (64, 160)
#: A state: (suffix, places in it as (offset, last token up to there, count up to there less the count now)).
START = ("", ((0, -1, 0),))
#: Stands for a special string in a row of symbols.
SPECIAL = "\uffff"


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.bpe = Encoder(vocabulary)
        self.ids = vocabulary.ids
        #: What a longer token begins with.
        self.heads = {s[:k] for s in vocabulary.ids for k in range(1, len(s))}
        self.blocks, self.words = Recent(KEPT_BLOCKS), Recent(KEPT_BLOCKS)
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[str, tuple]] = [START]
        self.number = {START: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{SPECIAL: (0, 1)}]

    def _number(self, state: tuple[str, tuple]) -> int:
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return n

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition from ``state`` on ``symbol``: next state and emitted tokens."""
        suffix, places = self.states[state]
        text, ids, heads, fits = suffix + symbol, self.ids, self.heads, self.bpe.compatible
        for at, last, count in places:  # the longest token first; exactly one candidate fits
            token = ids.get(text[at:])
            if token is not None and (last < 0 or fits(last, token)):
                break
        emitted = count + 1
        if symbol >= "\u0100":  # the word ends
            self.moves[state][symbol] = (0, emitted)
            return 0, emitted
        kept = [p for p in places if text[p[0] :] in heads]
        skip = kept[0][0] if kept else len(text)
        to = self._number((text[skip:], (*((j - skip, x, c - emitted) for j, x, c in kept), (len(text) - skip, token, 0))))
        self.moves[state][symbol] = (to, emitted)
        return to, emitted

    def run(self, state: tuple[str, tuple], row: str) -> tuple[tuple[str, tuple], int]:
        """The state that a row of symbols leads to from ``state``, and the tokens emitted on the way."""
        at, total, moves = self._number(state), 0, self.moves
        for symbol in row:
            move = moves[at].get(symbol)
            if move is None:
                if len(self.states) > KEPT_STATES:
                    here = self.states[at]
                    self._clear()
                    at, moves = self._number(here), self.moves
                move = self._compile(at, symbol)
            at, emitted = move
            total += emitted
        return self.states[at], total

    def word(self, word: str) -> int:
        """Tokens of one word of symbols, from the start state to the start state."""
        return self.run(START, word)[1]

    def row(self, block: str) -> str:
        """The symbols of a block."""
        cut = self.bpe.special.cut(block)
        return "".join(SPECIAL if special is not None else "".join(map(symbols, pieces(part))) for part, special in cut)

    def block(self, block: str) -> int:
        if (n := self.blocks.get(block)) is None:
            n = 0
            for part, special in self.bpe.special.cut(block):
                if special is not None:
                    n += 1
                    continue
                for word in pieces(part):
                    if (k := self.words.get(word)) is None:
                        k = self.word(symbols(word))
                        if len(word) <= LONGEST_KEPT:
                            self.words.put(word, k)
                    n += k
            if len(block) <= LONGEST_KEPT:
                self.blocks.put(block, n)
        return n

    def count(self, parts: list[str]) -> int:
        """Tokens of blocks."""
        found = list(map(self.blocks.new.get, parts))
        if None in found:
            find = self.block
            found = [find(b) if x is None else x for x, b in zip(found, parts)]
        return sum(found)


class ChunkMap:
    """What a chunk does to the state it is entered in: ``to`` has the exit state and the tokens emitted for each entry
    state asked for so far; ``find`` gives those of another one."""

    def __init__(self, find, states=()):
        self.find, self.to = find, {}
        for s in states:
            self(s)

    def __call__(self, state):
        if (known := self.to.get(state)) is None:
            known = self.to[state] = self.find(state)
        return known


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of chunk a followed by chunk b; associative."""

    def find(state):
        middle, first = a(state)
        end, second = b(middle)
        return end, first + second

    return ChunkMap(find, a.to)


def chunk_maps(machine: Transducer, text: str, chunk: int = CHUNK, size: int = BLOCKS) -> list[ChunkMap]:
    """The chunks of a text in order."""
    parts, out = blocks(text), []
    long = [i for i, b in enumerate(parts) if len(b) > chunk] if len(text) > chunk else []
    at = 0
    for i in [*long, len(parts)]:
        for k in range(at, i, size):
            # blocks end as they begin, in the start state
            n = machine.count(parts[k : min(i, k + size)])
            out.append(ChunkMap(lambda state, n=n: (state, n), [START]))
        if i < len(parts):
            row = machine.row(parts[i])
            for k in range(0, len(row), chunk):
                guesses = {machine.run(START, row[max(0, k - back) : k])[0] for back in LOOKBACKS}
                out.append(ChunkMap(lambda state, part=row[k : k + chunk]: machine.run(state, part), guesses))
        at = i + 1
    return out


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive scan: neighbours are composed in pairs, the halves scanned, the rest filled in (log depth)."""
    if len(maps) < 2:
        return list(maps)
    pairs = [compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
    scanned = prefix_scan(pairs)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(scanned[i // 2] if i % 2 else compose(scanned[i // 2 - 1], maps[i]))
    return out


def text_offsets(machine: Transducer, text: str, chunk: int = CHUNK, size: int = BLOCKS) -> list[int]:
    """Tokens up to the end of each chunk."""
    return [m(START)[1] for m in prefix_scan(chunk_maps(machine, text, chunk, size))]


def text_tokens(machine: Transducer, text: str, chunk: int = CHUNK, size: int = BLOCKS) -> int:
    return (text_offsets(machine, text, chunk, size) or [0])[-1]


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "n_tokens", offsets: str | None = None) -> DataFrame:
    """``docs`` and its token counts (long); with ``offsets``, also the tokens up to the end of each chunk (array<long>)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = Shared(spark, path or default_path())
    docs = docs.drop(out, *([offsets] if offsets else []))

    def run(batches):
        machine = _of(shared, Transducer)
        for batch in batches:
            found = [text_offsets(machine, t.as_py() or "") for t in batch.column(text)]
            batch = batch.append_column(out, pa.array([x[-1] if x else 0 for x in found], pa.int64()))
            yield batch.append_column(offsets, pa.array(found, pa.list_(pa.int64()))) if offsets else batch

    return docs.mapInArrow(run, with_fields(docs, (out, "long"), *([(offsets, "array<long>")] if offsets else [])))


def query(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
