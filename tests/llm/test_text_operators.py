"""Exact dedup, decontamination, line dedup, SimHash, BPE and counts against brute force, with edge cases."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from streetloom.llm import bpe, decontam, exact_dedup, line_dedup, simhash, token_counts
from streetloom.llm.vocab import Vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [None, "", " ", "\n\n", "a", "a b", "Ünï çødé x", "\x00\x1c\x85", "<|endoftext|> is<|startoftext|>", "word " * 3000, "x" * 5000, "日本語 テスト 123", "don't we'll 'S", "Σίσυφος ΑΣ İ", "é é"]


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], schema)


def rows(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def random_texts(n, seed, vocab=30, size=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, size))) for _ in range(n)]


# exact dedup


def blank(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup_equals_brute_force(spark):
    texts = [*EDGES, "a b", "ab", " a  b ", "a\tb", "\x85", *random_texts(40, 1, 2, 3)]
    got = rows(exact_dedup.exact_dedup(frame(spark, texts)))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(blank(t), []).append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert got[i] == [{"doc_id": i, "keep_id": keep, "group_size": len(ids), "kept": i == keep, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()}]


def test_exact_dedup_ids_ties_and_empty(spark):
    df = spark.createDataFrame([(-5, "x"), (9, "x"), (9, "x"), (None, "x"), (None, "y"), (2**62, "z z"), (1, "zz")], "doc_id long, text string")
    got = rows(exact_dedup.exact_dedup(df))
    assert got[-5][0]["kept"] and got[-5][0]["group_size"] == 4 and len(got[9]) == 2 and not got[9][0]["kept"]
    assert sorted(r["kept"] for r in got[None]) == [False, True] and [r["keep_id"] for r in got[None] if r["kept"]] == [None]
    assert got[1][0]["keep_id"] == 2**62
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_takes_colliding_hashes_apart(spark, monkeypatch):
    real = exact_dedup.F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: real(exact_dedup.F.substring(exact_dedup.F.col(c) if isinstance(c, str) else c, 1, 1)))
    got = rows(exact_dedup.exact_dedup(frame(spark, ["ab", "ac", "ab", "b", "b"])))
    assert [got[i][0]["keep_id"] for i in range(5)] == [0, 1, 0, 3, 3]


# decontamination


def contamination_brute(docs: list[tuple], items: list[tuple], n: int = decontam.WINDOW) -> dict:
    """By regular expression and nested loops."""
    import regex

    find = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for doc, text in docs:
        w, hit, ids = find(text), set(), set()
        for item, other in items:
            v = find(other)
            for k in range(max(1, len(v) - n + 1)) if v else ():
                window = v[k : k + n]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        ids.add(str(item))
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 12])
def test_decontamination_equals_brute_force(spark, block_words):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    long = [" ".join(rnd.choice(words) for _ in range(25)) for _ in range(4)]
    items = [(1, long[0]), (2, long[1]), (3, "Only FOUR words here"), (4, None), (5, ""), (6, long[0]), (10, "é über ñandú")]
    docs = [*EDGES, long[0], "zz " + long[1][:60] + " q", "only, four! words; here.", " ".join(long[0].split()[5:17]) + " " + "only four words here", "É über ñandú é ÜBER", *random_texts(30, 4, 6, 40)]
    df = frame(spark, docs)
    found = decontam.contamination(df, bench(spark, items), block_words=block_words)
    want = contamination_brute(list(enumerate(docs)), items)
    for r in found.collect():
        h = r["hits"]
        got = (h["n_words"], len(h["words"]), len(h["items"]), hashlib.sha256(",".join(h["items"]).encode()).hexdigest(), bool(h["words"]))
        assert got == want[r["doc_id"]], docs[r["doc_id"]]


def test_decontamination_cuts_spans_and_keeps_the_rest(spark):
    item = " ".join(f"t{i}" for i in range(12))
    docs = ["before this, " + item.upper() + ". And after it come many other words, enough of them to stay here.", item, "clean text", None]
    out = {r["doc_id"]: r["text"] for r in decontam.decontaminate(frame(spark, docs), bench(spark, [(1, item)])).collect()}
    assert out == {0: "before this, . And after it come many other words, enough of them to stay here.", 2: "clean text", 3: None}
    assert decontam.decontaminate(frame(spark, docs), bench(spark, [])).count() == 4
    assert decontam.decontaminate(frame(spark, []), bench(spark, [(1, item)])).count() == 0


# line dedup


def line_brute(docs, least):
    """Lines of each document that lie in a run of ``least`` words which occurs earlier."""
    seen, gone = {}, {}
    runs = []
    for d, t in docs:
        if t is None:
            continue
        ls = [(p, x.strip(" ")) for p, x in enumerate(t.split("\n")) if x.strip(" ")]
        n = [len(x.split(" ")) - x.split(" ").count("") for _, x in ls]
        for i in range(len(ls)):
            for j in range(i, len(ls)):
                if sum(n[i : j + 1]) >= least:
                    runs.append((d, ls[i][0], [p for p, _ in ls[i : j + 1]], ls[i][0], ls[j][0], tuple(x for _, x in ls[i : j + 1])))
                    break  # the shortest run from i
        for j in range(len(ls)):
            for i in range(j, -1, -1):
                if sum(n[i : j + 1]) >= least:
                    runs.append((d, ls[i][0], None, ls[i][0], ls[j][0], tuple(x for _, x in ls[i : j + 1])))
                    break
    for d, a, _, _, _, key in runs:
        seen[key] = min(seen.get(key, (d, a)), (d, a))
    for d, a, _, lo, hi, key in runs:
        if (d, a) > seen[key]:
            gone.setdefault(d, set()).update(range(lo, hi + 1))
    return gone


@pytest.mark.parametrize("hot_rows", [1_000, 2])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)  # with 2, hot and other keys both occur
    rnd = random.Random(5)
    pool = [f"line {i} " + " ".join(["w"] * rnd.randint(0, 6)) for i in range(12)] + ["", "  ", "x"]
    docs = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for _ in range(60)] + [None, "", "\n", "same line\n" * 30]
    got = {r["doc_id"]: (r["text"], r["removed"], r["total"]) for r in line_dedup.line_dedup(frame(spark, docs), 10, "total", "removed").collect()}
    gone = line_brute(list(enumerate(docs)), 10)
    assert gone
    for i, t in enumerate(docs):
        parts = (t or "").split("\n")
        kept = [x for p, x in enumerate(parts) if p not in gone.get(i, ())]
        assert got[i][0] == (None if t is None else "\n".join(kept)), i
        assert got[i][1] == len(parts) - len(kept) and got[i][2] == (len(parts) if t else 0)


def test_line_dedup_guarantee_any_maximal_run_goes_whole(spark):
    """A run of at least the words, with short lines at both ends, disappears to its last line."""
    run = "short\n" + " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(30)) + "\nend"
    docs = ["first before\n" + run + "\nfirst after", "other before\n" + run + "\nother after", run, "short\nend"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert out == {0: docs[0], 1: "other before\nother after", 2: "", 3: docs[3]}


def test_line_dedup_compares_anchors_only_and_extends_from_those_that_recur(spark):
    rnd = random.Random(9)
    own = lambda: [" ".join(f"{rnd.randrange(10**6)}" for _ in range(8)) for _ in range(200)]
    shared = own()[:40]
    docs = frame(spark, ["\n".join([*own(), *shared, *own()]) for _ in range(3)])
    x = line_dedup.winnowed(line_dedup.lines(docs), 50).cache()
    anchors = x.where("anchor is not null").count()
    assert anchors < 0.4 * x.count()  # 2 in 8 lines of windows of seven
    again = line_dedup.recurring(x)
    assert 0 < again.count() < 3 * 20
    tried = line_dedup.runs(x, again, 50).count()
    assert tried < 3 * 2 * 60 < x.count()
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(docs).collect()}
    assert [len(out[i]) for i in range(3)] == [440, 400, 400]


def test_line_dedup_takes_long_texts_in_proportion(spark):
    text = "\n".join(" ".join(f"{i * 7 + k}" for k in range(6)) for i in range(40_000))
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, [text, "a\n" + text + "\nb"])).collect()}
    assert out == {0: text, 1: "a\nb"}


def test_line_dedup_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1, 2), (1, text, 3, 4), (None, text, 5, 6), (2, text + "\nz", 7, 8)], "doc_id long, text string, _th long, h long")
    out = sorted((r["_th"], r["text"]) for r in line_dedup.line_dedup(df).collect())
    assert out == [(1, ""), (3, ""), (5, text), (7, "z")]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [
    "\t".join(f"cell{i}" for i in range(60)), "\u00a0".join(f"w{i}" for i in range(60)),
    "".join(chr(0x4E00 + i * 7) for i in range(60)) + "\u3002", "".join(chr(0x3042 + i) for i in range(30)) + "\n" + "".join(chr(0x30A2 + i) for i in range(30)), "".join(chr(0x0E01 + i % 40) for i in range(60)),
])
def test_line_dedup_counts_words_without_blanks(spark, run):
    docs = ["first before\n" + run + "\nfirst after", "other before\n\u00a0" + run + "\t\nother after"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert out == {0: docs[0], 1: "other before\nother after"}


def test_line_dedup_words(spark):
    want = {"a b": 2, "a\tb\u00a0\u3000c": 3, "a  b": 2, "\u4f60\u597d\uff0c\u4e16\u754c\u3002": 4, "\u300c\u4f60\u300dab c": 3, "\u0e01\u0e34\u0e19": 2, "": 0}
    got = spark.createDataFrame([(x,) for x in want], "line string").select("line", line_dedup.words_in(F.col("line")).alias("n")).collect()
    assert {r["line"]: r["n"] for r in got} == want


# SimHash


def simhash_brute(texts):
    from xxhash import xxh64_intdigest

    fps = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return fps, comp


def test_simhash_equals_brute_force(spark):
    base = random_texts(12, 6, 200, 300)
    rnd = random.Random(7)
    texts = [*EDGES, *base]
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(rnd.randint(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    fps, comp = simhash_brute(texts)
    got = rows(simhash.near_dedup(frame(spark, texts)))
    assert [got[i][0]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i][0]["component_id"] for i in range(len(texts))] == comp


@pytest.mark.parametrize(("chunk", "blocks"), [(4096, 6), (3, 5), (7, 7)])
def test_simhash_links_lose_no_pair_even_in_cut_buckets(spark, chunk, blocks):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for f in list(fps)[:12]:
        x = f
        for _ in range(12):
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.edges(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), blocks, chunk=chunk)
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    classes = {}
    for f in fps:
        classes.setdefault(root(f), set()).add(signed(f))
    for members in classes.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}
        else:
            assert not members & got.keys()


def test_simhash_pivot_table_discards_pairs_of_buckets(spark):
    """Random fingerprints that share 22 bits meet in buckets; the table leaves few to the XOR and loses no link."""
    rnd = random.Random(10)
    fps = {(k << 42) | rnd.getrandbits(42) for k in range(60) for _ in range(20)} | {(k << 42) | rnd.getrandbits(42) for k in range(100, 160) for _ in range(3)}
    fps |= {f ^ 0b1011 for f in sorted(fps)[:50]}
    signed = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = simhash.discards(signed).first()
    met = linked = 0
    for m in simhash.block_masks():
        groups = {}
        for x in fps:
            groups.setdefault(x & m, []).append(x)
        for g in groups.values():
            pairs = [(a, b) for i, a in enumerate(g) for b in g[i + 1 :]]
            met += len(pairs)
            linked += sum((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert (got["met"], got["linked"]) == (met, linked) and linked
    assert got["discarded"] > 0.9 * (met - linked)
    assert simhash.discards(signed.limit(0)).first()["met"] == 0


def test_simhash_keeps_one_and_survives_nulls_and_nothing(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (7, None), (8, ""), (9, "q")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one(df).collect()) == [(False, 2), (False, 7), (False, 9), (True, 0)]
    assert simhash.near_dedup(df.limit(0)).count() == 0


# BPE and counts


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def fuzz():
    rnd = random.Random(9)
    alpha = "abcdefghijklmnopqrstuvwxyz'éßçñ019.,!?-_#%$ \n\t<|>"
    parts = ["<|endoftext|>", "'s", "the", "ing", " ", "aaaa", "x", "Σ", "ΑΣ", "é", "é", "İ", "<|startoftext|>", "\x1c", " ", "\u0085", "haha", "12", "!'s", " "]
    return ["".join(rnd.choice(alpha if k % 2 else parts) for _ in range(rnd.randint(0, 50))) for k in range(1500)]


def test_encoding_is_the_librarys(spark, library):
    texts = [*EDGES, *fuzz()]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    out = rows(bpe.decode(bpe.encode(frame(spark, texts), decoded="decoded"), out="again"))
    for i in range(len(texts)):
        assert out[i][0]["ids"] == want[i], texts[i]
        assert out[i][0]["decoded"] == out[i][0]["again"] == library.decode(want[i], skip_special_tokens=False)


def test_every_code_point_is_the_librarys(library):
    encoder = bpe.Encoder(Vocabulary(bpe.default_path()))
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3400 or 0x9FF0 <= c < 0xAC10 or 0xD7A0 <= c < 0x20010 or 0x2A6D0 <= c < 0x34000 or c % 997 == 0)]
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}! " for c in points]
    for i in range(0, len(texts), 20000):
        want = library.encode_batch(texts[i : i + 20000], add_special_tokens=False)
        assert [t for t, w in zip(texts[i : i + 20000], want) if list(encoder.encode(t)) != w.ids] == []


def test_counts_are_the_librarys_at_any_chunk_size(spark, library):
    texts = [*EDGES, *fuzz()]
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    out = rows(token_counts.token_counts(frame(spark, texts)))
    assert [out[i][0]["n_tokens"] for i in range(len(texts))] == want
    machine = token_counts.Transducer(Vocabulary(bpe.default_path()))
    for chunk, size in ((1, 1), (3, 2), (8, 5)):
        assert [token_counts.text_tokens(machine, t or "", chunk, size) for t in texts[:400]] == want[:400]
    out = rows(token_counts.token_counts(frame(spark, [" ".join(t or "" for t in texts)]), offsets="upto"))[0][0]
    assert out["upto"][-1] == out["n_tokens"] and out["upto"] == sorted(out["upto"]) and len(out["upto"]) > 2


def test_chunk_maps_are_maps_of_states(library):
    """Chunks cut inside words: composed in any order they take every state where the whole row takes it."""
    machine = token_counts.Transducer(Vocabulary(bpe.default_path()))
    rnd = random.Random(12)
    text = "".join(rnd.choice("etaoinsr") for _ in range(3000)) + "'s<|endoftext|>" + "".join(rnd.choice("etaoinsr1!") for _ in range(3000))
    row, seen = machine.row(text), set()
    maps = token_counts.chunk_maps(machine, text, 100)
    assert len(maps) == -(-len(row) // 100)
    entered, added = token_counts.START, 0
    for k, m in enumerate(maps):
        added += entered not in m.to
        seen.add(entered)
        entered = m(entered)[0]
    assert entered == token_counts.START and len(seen) > 20 and added < len(maps) / 10  # looking back finds the states
    a, b, c = maps[3:6]
    for state in seen:
        whole = machine.run(state, row[300:600])
        assert token_counts.compose(token_counts.compose(a, b), c)(state) == token_counts.compose(a, token_counts.compose(b, c))(state) == whole
    scanned = token_counts.prefix_scan(maps)
    assert [m(token_counts.START) for m in scanned] == [machine.run(token_counts.START, row[: 100 * k + 100]) for k in range(len(maps))]
    assert scanned[-1](token_counts.START)[1] == len(library.encode(text, add_special_tokens=False).ids)


def test_very_long_words_and_texts(library):
    """Results are the library's, and states stay within their bound inside a word."""
    rnd = random.Random(13)
    text = "".join(rnd.choice("etaoinshrdlucmfwypvbg") for _ in range(300_000)) + " " + "a" * 100_000 + " \u65e5\u672c" * 20_000
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(bpe.Encoder(Vocabulary(bpe.default_path())).encode(text)) == ids
    machine = token_counts.Transducer(Vocabulary(bpe.default_path()))
    assert token_counts.text_tokens(machine, text) == len(ids)
    assert len(machine.states) <= token_counts.KEPT_STATES + 1


def test_transducer_states_may_start_anew(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KEPT_STATES", 5)
    machine = token_counts.Transducer(Vocabulary(bpe.default_path()))
    text = " ".join(random_texts(3, 2)) + " antidisestablishmentarianism electroencephalograph"
    assert token_counts.text_tokens(machine, text) == token_counts.text_tokens(machine, text, 4) == len(library.encode(text, add_special_tokens=False).ids)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7, 8, 9)], "doc_id long, text string, block long, ids long, Decoded long, n_tokens long, hits long")
    out = bpe.encode(df, decoded="decoded")
    assert out.columns == ["doc_id", "text", "block", "n_tokens", "hits", "ids", "decoded"] and out.first()["decoded"] == "a</w> b</w>"
    assert token_counts.token_counts(df).first()["n_tokens"] == 2
    assert decontam.contamination(df, bench(spark, [(1, "b")])).first()["hits"]["words"] == [1]
    assert simhash.fingerprints(df.withColumn("fp", df["ids"])).columns[-1] == "fp"
    assert line_dedup.line_dedup(df, n_lines="IDS").first()["IDS"] == 1
    assert bpe.encode(df.limit(0)).count() == token_counts.token_counts(df.limit(0)).count() == 0


def test_whole_tables_agree_with_the_libraries(spark, library):
    """The small driver tables, whole."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.query(spark, sf).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    for r in token_counts.query(spark, sf).collect():
        assert r["n_tokens"] == len(want[r["doc_id"]]) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    near = {k: t for k, t in texts.items() if k % 10 == 0 or k in {r["doc_id"] for r in decontam.query(spark, sf).where("contaminated").collect()}}
    brute = contamination_brute(list(near.items()), items)
    for r in decontam.query(spark, sf).collect():
        if r["doc_id"] in brute:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute[r["doc_id"]]
    fps, comp = simhash_brute([texts[k] for k in sorted(texts)])
    got = rows(simhash.query(spark, sf))
    assert [got[k][0]["fingerprint"] for k in sorted(texts)] == [f"{x:016x}" for x in fps]
    assert [got[k][0]["component_id"] for k in sorted(texts)] == [sorted(texts)[c] for c in comp]
