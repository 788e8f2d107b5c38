"""Operators that find equal, similar or repeated text, against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spotseam.llm import decontam, exact_dedup, induced, near_dup, repeats
from spotseam.llm.links import components

DOCS = "doc_id long, text string"


def texts(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def clashing(df):
    """With columns named like those that the operators use inside."""
    from pyspark.sql import functions as F

    return df.selectExpr("*", *[f"cast(doc_id as string) as `{c}`" for c in ("t", "th", "h", "chunk", "recipe", "node", "key", "kept", "x", "b", "s", "place", "lang", "_salt")]).withColumn("n", F.lit(None).cast("int"))


def brute_repeats(rows, length=400):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[s : s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone, end = bytearray(len(r)), 0
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                for j in range(max(s, end), s + length):
                    gone[j] = 1
                end = s + length
        spans = sum(1 for j in range(len(r)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    out = [(*x, *y) for x, y in zip(out, brute_passages(rows))]
    return sorted(out, key=str)


def brute_passages(rows, words=repeats.WORDS):
    """(passages, words in them) of each row."""
    texts = [[w for w in re.split("[\t-\r ]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[s : s + words]) for w in texts for s in range(len(w) - words + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - words + 1):
            if seen[tuple(w[s : s + words])] > 1:
                gone[s : s + words] = [True] * words
        out.append((sum(1 for j in range(len(w)) if gone[j] and (j == 0 or not gone[j - 1])), sum(gone)))
    return out


def test_repeats_brute_force(spark, sf):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh é") for _ in range(1500))
    rows = texts(spark, sf)[:120]
    rows += [(1000, base), (1001, "xx" + base[200:900] + "yy" + base[700:1300]), (1002, base[100:499]), (1003, base[100:500]), (1004, "z" * 900), (1005, "ab" * 300), (1006, None), (1007, ""), (None, base[300:1000]), (1008, base), (1008, base), (1009, base[:600] * 2), (1010, "q" * 400), (1011, base[1101:1500] + "!" + base[1100:1500])]
    got = repeats.remove_repeats(clashing(spark.createDataFrame(rows, DOCS)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)


def test_repeats_many_ends_of_one_passage(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(700)
    rows = [(i, word(rng.randint(0, 300)) + passage[rng.randint(0, 250) :] + word(rng.randint(0, 300))) for i in range(60)]
    assert sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_repeats(rows)


def test_passages_shorter_than_the_removed_strings(spark):
    """Passages of 50 words and more in few bytes: told of, not removed; one word less is none."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    own = lambda: [word() + str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 90))]
    rows = [(i, " ".join(own() + passage[a:b] + own())) for i, (a, b) in enumerate([(0, 60), (0, 60), (5, 57), (0, 50), (0, 49), (11, 60), (3, 59)])]
    rows += [(10, " ".join(own())), (11, " \n" + "\t ".join(passage)), (15, " ".join(passage).upper()), (12, " ".join(passage + passage)), (13, "a " * 200), (14, None)]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == brute_repeats(rows)
    facts = {r[0]: r[5:] for r in got}
    assert facts[0] == (1, 60) and facts[4] == (0, 0) and facts[10] == (0, 0) and facts[11] == (1, 60) and facts[15] == (0, 0) and all(r[2] == 0 for r in got if r[0] < 11)


def test_induced_sorting_equals_plain_sorting(tmp_path):
    """Suffixes and common prefixes of small texts of few letters, with queues that hold two records."""
    rng = random.Random(1)
    for _ in range(400):
        t = [rng.randint(1, rng.choice([2, 3, 5])) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.3:
            t = t + t[: rng.randint(1, len(t))] + t
        want, order = [], sorted(range(len(t)), key=lambda i: t[i:])
        for a, i in enumerate(order):
            k, j = 0, order[a - 1]
            while a and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            want.append((i, k))
        disk = induced.Disk(str(tmp_path))
        run = induced.sorted_suffixes(np.array(t), disk, held=rng.choice([2, 5, 1000]))
        assert [(i, k) for i, k, _, _ in run.records()] == want
        run.drop()
        assert disk.now == 0 and not list(tmp_path.iterdir())


def test_induced_removal_equals_the_operator(spark, sf):
    rows = texts(spark, sf)[:40] + [(1000, "ab" * 300), (1001, None), (1002, "é" * 500)]
    got, disk = induced.remove_repeats_of_shard([(t or "").encode() for _, t in rows], held=1000)
    assert sorted(((i, *x) for (i, _), x in zip(rows, got)), key=str) == [x[:5] for x in brute_repeats(rows)]
    assert disk.most > 0


def test_repeats_over_one_segment(spark):
    """A text of more than one segment, and a copy of its middle across the seam."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghij klmnop") for _ in range(repeats.SEGMENT + 5000))
    seam = long[repeats.SEGMENT - 700 : repeats.SEGMENT + 900]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame([(1, long), (2, "#" + seam + "#")], DOCS)).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (1600, 1, 1600)
    kept = long[: repeats.SEGMENT - 700] + long[repeats.SEGMENT + 900 :]
    assert got[1]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_repeats_long_texts_in_segments():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 105, 5000, dtype=np.uint8).tobytes()
    whole = sum((hi - lo + 1).sum() for part in repeats.segments([raw]) for lo, hi, _, _ in [repeats.nodes_of(np.frombuffer(b"".join(x[2] for x in part), np.uint8), [len(x[2]) for x in part])])
    small = 0
    for part in repeats.segments([raw, b"x" * 399, b""], segment=700, batch=2000):
        lo, hi, p, _ = repeats.nodes_of(np.frombuffer(b"".join(x[2] for x in part), np.uint8), [len(x[2]) for x in part])
        assert (lo <= hi).all() and (p >= hi).all() and (p - lo <= 272).all()
        small += (hi - lo + 1).sum()
    assert whole == small == 5000 - 400 + 1


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_brute_force(spark, sf, bits):
    long = "word of many letters and lines " * 3000
    rows = texts(spark, sf)[:80] + [(900, "a  b"), (901, "a\tb"), (902, "a b "), (903, None), (904, ""), (905, " "), (906, long), (907, long + " "), (908, long[:-40] + "x" + long[-39:]), (908, "a b"), (909, long), (909, long), (910, "a b")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_dedup(clashing(spark.createDataFrame(rows, DOCS)), hash_bits=bits)
    assert sorted(map(tuple, got.collect())) == want


def shingle_sets(rows, k=5):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute_classes(rows, similar=0.8):
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= similar * max(len(a), len(b)) and (a == b or len(a & b) >= similar * len(a | b)):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, min(least[find(i)]), len(least[find(i)])) for i, (d, _) in enumerate(rows))


def near_rows(spark, sf):
    rng = random.Random(9)
    rows = texts(spark, sf)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    for i in range(60):  # one group whose members are closer to the middle than to one another
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(200)] = f"x{rng.randint(0, 10**6)}"
        rows.append((2000 + i, " ".join(w)))
    chain = list(base[::-1])
    for i in range(12):  # each a copy of the one before but for two words
        chain[i * 16 % 200] = f"c{i}"
        rows.append((3000 + i, " ".join(chain)))
    return rows + [(4000, None), (4001, ""), (4002, "  "), (4003, "one two"), (4004, "One  two"), (4005, "one three"), (4006, "A " * 500), (4007, "a a a a a a")]


def test_near_dedup_brute_force(spark, sf):
    rows = near_rows(spark, sf)
    got = near_dup.near_dedup(clashing(spark.createDataFrame(rows, DOCS)))
    found = got.collect()
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_near_dedup_without_help_of_hubs(spark, sf, monkeypatch):
    """With one word of blocks and one band of one row, nearly all pairs come from the blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "AGREE", 0.0)
    rows = near_rows(spark, sf)[-90:]
    got = near_dup.near_dedup(spark.createDataFrame(rows, DOCS), bands=30, rows=1)
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in got.collect()) == brute_classes(rows)


def test_near_dedup_counted(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a), (2, a + " " + a), (3, a + " x")]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dedup(spark.createDataFrame(rows, DOCS), weights="count").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_near_dedup_counted_prunes_by_total_weight(spark):
    """A similar pair of few and many distinct elements in one bucket, whose hub is like neither."""
    elements = near_dup._Elements(near_dup.SHINGLE, True)

    def made(text):
        e, w = elements.of([text])
        return near_dup.dart_signatures(e, w, 1)[0, 0], elements.name(e[0], w[0])

    base = " ".join(["a"] * 104)
    more = lambda n, i: base + "".join(f" w{i}x{j}" for j in range(n))
    sig, name = made(base)
    twin = next(t for t in (more(10, i) for i in range(100)) if made(t)[0] == sig)
    hub = next(t for t in (more(100, i) for i in range(100, 2000)) if made(t)[0] == sig and made(t)[1] < min(name, made(twin)[1]))
    rows = [(1, base), (2, twin), (3, hub)]
    got = near_dup.near_dedup(spark.createDataFrame(rows, DOCS), bands=1, rows=1, weights="count")
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    wa, wb = rng.uniform(0.1, 4, len(e)), rng.uniform(0.1, 4, len(e))
    k = 4096
    sig = near_dup.dart_signatures([e, e], [wa, wb], k)
    assert abs((sig[0] == sig[1]).mean() - near_dup.similarity(e, e, wa, wb)) < 0.03
    a, b = e[:300], e[100:]
    sig = near_dup.dart_signatures([a, b, e[:1]], None, k)
    assert abs((sig[0] == sig[1]).mean() - near_dup.similarity(a, b)) < 0.03


def test_components(spark):
    rng = random.Random(2)
    links = [(a, a + 1) for a in range(0, 40)] + [(100, x) for x in range(101, 150)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    import itertools

    for a, b in links:
        if a != b:
            assert got[a] == got[b]
    assert len({got[x] for x in range(0, 41)}) == 1
    assert got[0] != got[100]
    sizes = [len(list(g)) for _, g in itertools.groupby(sorted(got.values()))]
    assert sum(sizes) == len(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_overlaps(rows, items, least=decontam.LEAST):
    clean = lambda t: [x for x in (w.strip(decontam._PUNCTUATION) for w in (t or "").lower().split()) if x]
    out = set()
    docs = [(d, clean(t)) for d, t in rows]
    for item, t in items:
        w = clean(t)
        if len(w) < decontam.SHORTEST:
            continue
        need = min(least, len(w))
        for d, v in docs:
            for g in range(-len(w) + 1, len(v)):
                run = best = same = top = 0
                for j in range(max(0, g), min(len(v), g + len(w))):
                    eq = v[j] == w[j - g]
                    run, same = (run + (1 if eq else -3), same + eq)
                    if run <= 0:
                        run = same = 0
                    if run > best:
                        best, top = run, same
                if top >= need:
                    out.add((d, item))
    return out


def test_decontamination_brute_force(spark, sf):
    rng = random.Random(4)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12] + [(900, "four words are here"), (901, "too short"), (902, None), (903, "")]
    rows = texts(spark, sf)[:50]
    for i, (item, t) in enumerate(items[:12]):
        w = t.split()
        for at in range(rng.randint(3, 8), len(w), 9):  # one substitution in nine words
            w[at] = f"sub{at}"
        rows.append((5000 + i, "some words before " + " ".join(w).upper() + " and after"))
    rows += [(6000, "x Four words, are here! y"), (6001, "four words were here"), (6002, None), (6003, ""), (6000, "x Four words, are here! y")]
    got = decontam.decontaminate(clashing(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(items, "item_id long, text string"))
    found = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert set(found) == brute_overlaps(rows, items)
    assert found.count((6000, 900)) == 2
    small = decontam.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), bits=64)  # a bitmap that keeps nearly everything
    assert sorted((r["doc_id"], r["item_id"]) for r in small.collect()) == sorted(found)
    kept = decontam.without_contaminated(clashing(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert "_salt" in kept.columns


def brute_stretch(v, w, g):
    """(first word, words, equal words) on a diagonal by the documented rule alone: all stretches that begin with an equal word tried."""
    lo, hi = max(0, g), min(len(v), g + len(w))
    best = (0, 0, 0)
    for i in (i for i in range(lo, hi) if v[i] == w[i - g]):
        for j in range(i + 1, hi + 1):
            same = sum(v[k] == w[k - g] for k in range(i, j))
            if 4 * (j - i - same) <= j - i and (same, -i, i - j) > best:
                best = (same, -i, i - j)
    return -best[1], -best[2], best[0]


def test_overlap_is_the_documented_rule(spark):
    rng = random.Random(6)
    for _ in range(300):
        w = list(range(rng.randint(1, 24)))
        v = [x if rng.random() < 0.75 else -1 for x in w]
        v, g = rng.choice([(v, 0), ([-2] * 3 + v, 3), (v[4:], -4)])
        got, want = decontam.overlap(np.array(v), np.array(w), g), brute_stretch(v, w, g)
        assert got == want if want[2] else got[1:] == (0, 0)
    item = [f"w{i}" for i in range(20)]
    swapped = lambda n, *at: " ".join(f"s{i}" if i in at else item[i] for i in range(n))
    rows = [(1, "before " + swapped(15, 11) + " after"), (2, swapped(20, 3, 7, 15, 17)), (3, swapped(15, 2, 6, 9, 12))]
    items = spark.createDataFrame([(15, " ".join(item[:15])), (20, " ".join(item))], "item_id long, text string")
    got = decontam.decontaminate(spark.createDataFrame(rows, DOCS), items).collect()
    assert sorted(tuple(r) for r in got) == [(1, 15, 1, 15, 14), (1, 20, 1, 15, 14), (2, 15, 0, 15, 13), (2, 20, 0, 20, 16)]
    kept = decontam.without_contaminated(spark.createDataFrame(rows, DOCS), items)
    assert [r["doc_id"] for r in kept.collect()] == [3]


def test_very_long_texts(spark):
    """Over a megabyte: a benchmark item deep inside is found at its word, and near copies are."""
    rng = random.Random(21)
    many = [f"word{rng.randint(0, 10**6)}" for _ in range(120_000)]
    item = [f"item{i}" for i in range(30)]
    other = list(many)
    for i in range(0, len(other), 60):  # one word in sixty: 0.85 similar
        other[i] = f"new{i}"
    rows = [(1, " ".join(many[:100_000] + item + many[100_000:])), (2, " ".join(other)), (3, "short text of a few words"), (4, None)]
    df = spark.createDataFrame(rows, DOCS)
    found = decontam.decontaminate(df, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 9, 100_000, 30, 30)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert len(rows[0][1]) > 1_000_000


def test_near_dedup_with_null_ids(spark):
    """Hundreds of rows of null id: texts are fetched by id and hash, and every class is whole."""
    base = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 120, 2)] + [(None, " ".join(base))] * 3 + [(None, "something else altogether here")]
    got = near_dup.near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["class_size"] for r in got) == [1] + [63] * 63
    kept = [r for r in got if r["kept"]]
    assert len({(r["class_size"], r["text_hash"]) for r in kept}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert repeats.remove_repeats(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dup.near_dedup(none).count() == 0
    assert decontam.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        exact_dedup.exact_dedup(spark.createDataFrame([(1,)], "doc_id long"))
