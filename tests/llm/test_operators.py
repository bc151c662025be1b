"""Small cases of every operator: nulls, empties, repeats, odd texts, empty tables, other columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import bagminhash, bm25, components, decontaminate, lines, pitman_yor, shards, substrings, toxicity, url_filters

DOC = "doc_id long, text string, lang string, key string, words string"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefgé") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = prose(120, 1), prose(60, 2)
    changed = base.split()
    changed[50] = "zzz"
    texts = [base, base, " ".join(changed), None, "", "one", "one  two\tthree", passage + " " + prose(30, 3), prose(20, 4) + "\n" + passage, "a " * 200, "É x\x00y 🙂 " * 3]
    rows = [(i, t, "en", "k", "w") for i, t in enumerate(texts)] + [(None, prose(50, 9), None, None, None), (5, "one", "en", "k", "w"), (20, prose(3000, 11), "de", "k", "w")]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_substrings(docs, none):
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = []
    for doc, w in rows:
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        want.append((doc, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = [tuple(r) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(none).count() == 0


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.class_id) for r in bagminhash.near_duplicates(docs).collect()}
    assert {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (20, 20), (None, None)} <= got
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 5, 6, 7, 8, 9, 10, 20]
    assert bagminhash.near_duplicates(none).count() == 0


def test_bagminhash_is_unbiased():
    errors, rng = [], random.Random(2)
    for trial in range(60):
        a = Counter({i: rng.randint(1, 6) for i in range(60)})
        b = Counter({i: rng.randint(1, 6) if rng.random() < 0.5 else a.get(i, 1) for i in range(rng.randint(0, 20), 70)})
        run = np.array([hash((x, trial)) & 0xFFFFFFFFFFFF for x in [*a, *b]], np.uint64)
        doc, count = np.array([0] * len(a) + [1] * len(b)), np.array([*a.values(), *b.values()])
        s = bagminhash.signatures(doc, run, count, 2)
        errors.append((s[0] == s[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (100, 102), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark, none):
    long = prose(80, 21)
    edited = long.replace(long.split()[40], long.split()[40] + "x", 1)
    rows = [(1, f"{long}\nunique {prose(9, 22)}\n\n"), (2, f"  {long.upper().replace('É', 'é')}\nother {prose(9, 23)}"), (3, edited), (4, None), (5, ""), (None, "nothing like it " + prose(12, 24)), (6, f"{long}")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, line_no string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[4].text is None and got[5].text == "" and got[None].text == rows[5][1]
    assert got[2].n_removed == 1 and got[2].text.startswith("other") and got[6].text == "" and got[6].n_removed == 1
    assert got[3].text in (edited, "") and got[1].key == "x"
    assert lines.dedup_lines(none).count() == 0


def _edited(line: str, rng: random.Random, kind: str) -> str:
    """line with a fifth of its words or characters replaced, at most."""
    parts = line.split() if kind == "words" else list(line)
    for i in rng.sample(range(len(parts)), max(1, int(len(parts) * rng.uniform(0.05, 0.2)))):
        parts[i] = rng.choice(VOCABULARY) if kind == "words" else rng.choice("abcdefghij")
    return " ".join(parts) if kind == "words" else "".join(parts)


def line_recall(spark, kind: str, count: int = 100) -> tuple[set, set]:
    """Lines with an earlier one at edit similarity 0.8, by brute force, and those removed."""
    rng, rows = random.Random(31), []
    for i in range(count):
        line = prose(rng.randint(5, 60), 1000 + i)
        rows += [(2 * i, line), (2 * i + 1, _edited(line, rng, kind))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache()
    pairs = df.alias("x").crossJoin(df.alias("y")).where("x.doc_id < y.doc_id and levenshtein(x.text, y.text, cast(floor(0.2 * greatest(length(x.text), length(y.text))) as int)) >= 0")
    want = {r[0] for r in pairs.select("y.doc_id").collect()}
    return want, {r.doc_id for r in lines.dedup_lines(df).where("n_removed = 1").select("doc_id").collect()}


def test_line_recall_of_changed_words(spark):
    want, got = line_recall(spark, "words")
    assert got <= want and len(want) > 80 and len(got) >= 0.99 * len(want)


def test_lines_that_meet_by_boilerplate_alone(spark):
    rng = random.Random(9)
    boilerplate, rows = prose(16, 71), []
    for i in range(12):
        own = [f"{w}{rng.choice('abcdefghij')}{w[::-1]}" for w in prose(20, 7100 + i).split()]
        turned = [w[:-1] + "z" for w in own]
        rows += [(2 * i, f"{boilerplate} {' '.join(own)}"), (2 * i + 1, f"{boilerplate} {' '.join(turned)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = df.alias("x").crossJoin(df.alias("y")).where("x.doc_id < y.doc_id and levenshtein(x.text, y.text, cast(floor(0.2 * greatest(length(x.text), length(y.text))) as int)) >= 0")
    want = {r[0] for r in pairs.select("y.doc_id").collect()}
    assert want == {2 * i + 1 for i in range(12)}
    assert {r.doc_id for r in lines.dedup_lines(df).where("n_removed = 1").select("doc_id").collect()} == want


def test_lines_that_differ_by_punctuation(spark):
    line = prose(12, 41).split()
    rows = [(1, "---\n" + " ".join(line) + "\n}"), (2, "---\n" + ", ".join(line) + "\r\n}"), (3, "\t" + "\t".join(line) + ".\n---")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "---\n}", 3: "---"}


def test_line_near_one_of_two_with_the_same_words(spark):
    words = [f"{w}{i}" for i, w in enumerate(prose(60, 51).split())]
    turned, plain = " ".join(reversed(words)), " ".join(words)
    rows = [(1, turned), (2, turned), (3, turned), (4, plain), (5, plain.replace(words[30], "zzzz"))]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_edit_similarity(spark):
    df = spark.createDataFrame([("abcdefghij", "abcdefghxy"), ("abcdefghij", "abcdefgxyz"), ("w " * 3000, "w " * 2900 + "v " * 100)], "a string, b string")
    got = [r[0] for r in df.select(lines._edit_similar(F.trim("a"), F.trim("b"), 0.8)).collect()]
    assert got == [True, False, True]


def test_long_lines_are_measured_in_characters(spark):
    words = [f"{i:x}" for i in range(1500)]
    changed = ["x" + w[1:] if i % 4 == 0 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(" ".join(words), " ".join(changed))], "a string, b string")
    assert df.select(lines._edit_similar(F.col("a"), F.col("b"), 0.8)).first()[0]


def test_leaks(spark, docs, none):
    item = prose(60, 2).split()[5:25]
    items = spark.createDataFrame([(1, " ".join(item).title()), (2, "One two, THREE"), (3, None), (4, "..."), (10, " ".join(item)), (11, "absent words here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, items).collect()}
    shared = [r for d, r in got.items() if r["items"] and d != 6]
    assert {r.doc_id for r in shared} == {7, 8} and all("10" in r["items"] for r in shared)
    assert got[6]["items"] == ["2"] and got[6].n_words == 3 and got[3].n_words == 0 and got[4].hits == []
    assert decontaminate.find_leaks(docs, items).count() == docs.count()
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.where("item_id > 99")).where("size(hits) > 0").count() == 0
    clash = docs.withColumn("hits", F.lit(1)).withColumn("items", F.lit("z")).withColumn("n_words", F.lit(2))
    clean = decontaminate.without_leaks(clash, items)
    assert clean.columns == clash.columns and clean.count() == docs.count() - 3 and {7, 8, 6}.isdisjoint(r.doc_id for r in clean.collect())
    assert decontaminate.find_leaks(clash, items, keep=("doc_id", "hits", "lang")).columns == ["doc_id", "lang", "n_words", "hits", "items"]
    assert decontaminate.without_leaks(none, items).count() == 0


def test_shards(docs, none):
    rows = shards.shuffle_shards(docs, n_shards=4, rows_per_partition=4).collect()
    counts = Counter(r.shard for r in rows)
    assert sum(counts.values()) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    assert shards.shuffle_shards(none).count() == 0
    m = shards.communication_matrix([5, 0, 9, 3], 3, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 3] and m.sum(axis=0).tolist() == [6, 6, 5]


def test_shuffle_is_uniform(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shards.shuffle_shards(df, n_shards=4).collect()
    first_half = Counter(r.shard for r in rows if r.doc_id < 2000)
    assert all(abs(first_half[s] - 500) < 80 for s in range(4))


def test_language_model(docs, none):
    train = F.coalesce(F.col("doc_id"), F.lit(0)) != 2
    got = pitman_yor.score_texts(docs, train).collect()
    rows = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)), 0]) for r in docs.collect()]
    count = Counter(w for d, ws in rows for w in ws if d != 2)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score - r.base_score for r in got) > 0
    assert pitman_yor.score_texts(none, F.lit(True)).count() == 0


def _seatings(c: int, pull: float, discount: float) -> np.ndarray:
    s = pitman_yor.Stirling(discount, exact=c).table[c, 1:]
    weight = s + np.arange(1, c + 1) * math.log(pull)
    weight = np.exp(weight - weight.max())
    return weight / weight.sum()


def test_seating_matches_its_distribution():
    s = np.exp(pitman_yor.Stirling(0.5).table[3])
    # partitions of three customers: sizes 3; 2+1 three ways; 1+1+1
    assert s[1] == pytest.approx(0.5 * 1.5) and s[2] == pytest.approx(3 * 0.5) and s[3] == pytest.approx(1)
    rng, n = np.random.default_rng(1), 40_000
    base = 0.2
    for c, pull in ((3, 0.7), (12, 2.0)):
        drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, math.log(pull)), pitman_yor.Flat(math.log(base)), pitman_yor.Stirling(0.5), rng)
        got = np.bincount(drawn, minlength=c + 1)[1:] / n
        assert np.abs(got - _seatings(c, pull * base, 0.5)).sum() / 2 < 0.015


def test_seating_of_many_customers():
    """Beyond the exact table: total variation against exact numbers at 900 customers."""
    for discount in (0.1, 0.3, 0.5, 0.7, 0.8):
        numbers = pitman_yor.Stirling(discount)
        for pull in (0.01, 0.3, 3.0, 30.0, 300.0):
            weight = numbers.of(900, 900) + np.arange(1, 901) * math.log(pull)
            weight = np.exp(weight - weight.max())
            assert np.abs(weight / weight.sum() - _seatings(900, pull, discount)).sum() / 2 < 0.02, (discount, pull)


def _direct_scores(texts: list[list], learned: list[bool], d: float, strength: float, root_strength: float, sweeps: int, burn: int) -> np.ndarray:
    """Gibbs over single customers, all tables kept apart: mean predictive probabilities, log10 by text.
    The parent's discount is estimated as the operator does, from its customers of one and two."""
    rng = random.Random(3)
    vocabulary = {w for t, on in zip(texts, learned, strict=True) if on for w in t}
    pairs = [(c, w) for t, on in zip(texts, learned, strict=True) if on for c, w in zip(["<"] + t[:-1], t, strict=True)]
    rooms: dict = {}
    root: dict = {w: [] for w in vocabulary}
    d0 = 0.5

    def back(w):
        own = root.get(w, [])
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(own) - d0 * len(own) + (root_strength + d0 * t) / (len(vocabulary) + 1)) / (root_strength + n)

    def draw(weights):
        return rng.choices(range(len(weights)), weights)[0]

    def add(tables: dict, w, discount, theta, base):
        own, t = tables.setdefault(w, []), sum(map(len, tables.values()))
        k = draw([x - discount for x in own] + [(theta + discount * t) * base])
        if k < len(own):
            own[k] += 1
            return False
        own.append(1)
        return True

    def remove(tables: dict, w):
        own = tables[w]
        k = draw(own)
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    def seat(c, w):
        if add(rooms.setdefault(c, {}), w, d, strength, back(w)):
            add(root, w, d0, root_strength, 1 / (len(vocabulary) + 1))

    for c, w in pairs:
        seat(c, w)
    want = sorted({(c, w) for t in texts for c, w in zip(["<"] + t[:-1], t, strict=True)})
    sums = dict.fromkeys(want, 0.0)
    for number in range(sweeps):
        for c, w in pairs:
            if remove(rooms[c], w):
                remove(root, w)
            seat(c, w)
        sizes = [sum(x) for x in root.values()]
        d0 = pitman_yor._discount(sizes.count(1), sizes.count(2))
        if number >= burn:
            for c, w in want:
                room = rooms.get(c, {})
                own, n, t = room.get(w, []), sum(map(sum, room.values())), sum(map(len, room.values()))
                sums[c, w] += (sum(own) - d * len(own) + (strength + d * t) * back(w)) / (strength + n)
    return np.array([sum(math.log10(sums[c, w] / (sweeps - burn)) for c, w in zip(["<"] + t[:-1], t, strict=True)) for t in texts])


def test_language_model_against_a_direct_sampler(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(VOCABULARY[:12], [1 / (i + 1) for i in range(12)], k=rng.randint(3, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [[*t.lower().split(), ">"] for t in texts]
    learned = [i % 4 != 1 for i in range(40)]
    count = Counter((c, w) for t, on in zip(words, learned, strict=True) if on for c, w in zip(["<"] + t[:-1], t, strict=True))
    d = pitman_yor._discount(sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values()))
    want = _direct_scores(words, learned, d, pitman_yor.STRENGTH, pitman_yor.STRENGTH_ROOT, 300, 60)
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(df, F.col("doc_id") % 4 != 1, samples=4).collect()}
    gap = np.array([got[i] for i in range(40)]) - want
    assert np.abs(gap / [len(t) for t in words]).max() < 0.02, gap


def test_language_model_in_many_buckets(spark, monkeypatch):
    """Small buckets, batches and tables: split contexts, fat pairs, words without a code."""
    texts = [prose(60, 700 + i % 50) + " the same pair the same pair" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r for r in pitman_yor.score_texts(df, F.col("doc_id") % 7 != 2).collect()}
    for name, value in (("BUCKET_TOKENS", 3000), ("FLUSH_WORDS", 4000), ("FAT", 8)):
        monkeypatch.setattr(pitman_yor, name, value)
    parts = {r.doc_id: r for r in pitman_yor.score_texts(df, F.col("doc_id") % 7 != 2).collect()}
    assert len(parts) == 300 and all((parts[i].n_tokens, parts[i].n_known) == (whole[i].n_tokens, whole[i].n_known) for i in whole)
    assert all(abs(parts[i].base_score - whole[i].base_score) < 1e-6 and abs(parts[i].score - whole[i].score) < 0.03 * abs(whole[i].score) for i in whole)


def test_search(docs, none):
    k = 5
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in bm25.top_k(docs.where("doc_id is not null"), docs.where("doc_id % 20 = 0"), k, shard_rows=4).collect())
    rows = [(r.doc_id, Counter(re.findall("[0-9a-z\u0080-\U0010ffff]+", lower(r.text)))) for r in docs.where("doc_id is not null").collect()]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    df = Counter(t for _, c in rows for t in c)
    want = []
    for q, qc in rows:
        if q % 20:
            continue
        scored = []
        for d, c in rows:
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, m in qc.items() if t in c)
            if s > 0:
                scored.append((-round(s, 6), d))
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=1e-5)
    assert bm25.top_k(none, none).count() == 0


def test_search_of_wordless_shards_and_repeated_queries(spark):
    df = spark.createDataFrame([(0, "..."), (1, None), (20, "rare word"), (20, "rare word"), (3, "word and rare"), (4, "")], "doc_id long, text string")
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in bm25.top_k(df, df.where("doc_id % 20 = 0"), 3, shard_rows=1).collect()}
    once = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in bm25.top_k(df, df.where("doc_id = 20").limit(1), 3, shard_rows=4).collect()}
    assert got == once and [got[20, i][0] for i in (1, 2, 3)] == [20, 20, 3]
    assert bm25.top_k(df.where("doc_id < 2"), df.where("doc_id < 2"), 3).count() == 0


def test_search_prunes_blocks():
    """One shard against brute force, with blocks left out."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'abcd'[i % 4]}{int(t)}" for t in rng.zipf(1.3, rng.integers(5, 80)) % 500) for i in range(2000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(np.zeros(2000, np.int32)), pa.array(texts)], ["id", "shard", "text"])
    index = bm25.build(pa.Table.from_batches(list(bm25.deal(1)([batch]))))
    shard = bm25.Shard(index["payload"][0].as_py(), 40.0)
    counted = next(bm25.counted(pa.array(texts)))
    doc, term, count = counted[2], counted[3], counted[4]
    idf = {t: np.log(2000 / n) for t, n in zip(*np.unique(term, return_counts=True), strict=True)}
    queries = [(term[doc == q], count[doc == q] * np.array([idf[t] for t in term[doc == q]])) for q in range(0, 2000, 50)]
    norm = bm25.K1 * (1 - bm25.B + bm25.B * counted[5] / 40.0)
    for (terms, weights), (ids, scores) in zip(queries, shard.search(queries, 10, np.zeros(len(queries))), strict=True):
        w = dict(zip(terms.tolist(), weights.tolist(), strict=True))
        full = np.bincount(doc, weights=[w.get(t, 0.0) for t in term.tolist()] * (count * 2.2 / (count + norm[doc])), minlength=2000)
        order = np.lexsort((np.arange(2000), -np.round(full, 9)))[:10]
        assert ids.tolist() == order.tolist() and np.allclose(scores, full[order])
    assert shard.scored < 0.6 * shard.blocks


def test_toxicity(spark, none):
    rows = [(i, prose(30, 100 + i) + (" vilest" if i % 5 == 0 else ""), "en", "k", "w") for i in range(400)] + [(900, None, None, None, None), (901, "", "en", "k", "w")]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.score for r in toxicity.with_scores(df, model).collect()}
    right = [(got[i] >= 0.5) == (i % 5 == 0) for i in range(300, 400)]
    assert len(got) == 402 and sum(right) >= 95 and all(0 <= s <= 1 for s in got.values())
    flat = toxicity.train(df, labels.where("toxic = 0"))
    assert toxicity.with_scores(df, flat).select("score").distinct().count() == 1
    assert toxicity.with_scores(none, model).count() == 0 and toxicity.train(none, labels).thresholds == {}


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    # a word that only labels beyond any fixed number of rows, and long texts, teach
    rows = [(i, prose(12, 100 + i) + (" vilest" if i % 4 == 0 else ""), "en", "k", "w") for i in range(600)]
    rows += [(1000 + i, "grubbiest " + prose(6000, 50 + i % 3), "de", "k", "w") for i in range(30)]
    df = spark.createDataFrame(rows + [(2000, "grubbiest " + prose(12, 77), "en", "k", "w")], DOC)
    labels = spark.createDataFrame([(r[0], int(r[0] >= 1000 or r[0] % 4 == 0)) for r in rows], "doc_id long, toxic int")
    seen, counted = spark.sparkContext.accumulator(0), toxicity._counted

    def counting(table):
        seen.add(table.num_rows)
        return counted(table)

    monkeypatch.setattr(toxicity, "_counted", counting)
    model = toxicity.train(df, labels, part=200)
    assert 400 < seen.value < 630
    got = {r.doc_id: r.score for r in toxicity.with_scores(df, model).collect()}
    right = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(600)]
    assert sum(right) >= 570 and got[2000] > 0.5


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://blog.a.example.com/en/", "http://a.net/es/x#y", "http://a.net/de/", "no url", None, "x://h", "http://example.com", "a://b://c/d", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(3, True)] * 3 + [(None, True), (6, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, outcomes).collect()}
    assert [got[i].rule for i in range(10)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, None, "com/"]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/1") and (got[4].host, got[4].path, got[5].host) == ("", "", "") and got[8].host == "b:"
    assert [got[i].verdict for i in (0, 1, 2, 9)] == ["allow", "block", "block", "allow"]
    assert {r.verdict for r in url_filters.judge_urls(pages, outcomes.where("page_id > 99")).where("rule is null").collect()} == {"allow"}
    assert url_filters.judge_urls(pages.where("page_id > 99"), outcomes).count() == 0


def test_lines_edit_similarity_is_the_distance_itself(spark):
    rng, rows = random.Random(11), []
    for n in (3, 8, 15, 40):
        for _ in range(40):
            words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
            line = list(" ".join(words))
            share = rng.choice([0.05, 0.1, 0.18, 0.2, 0.25])
            for at in rng.sample(range(len(line)), int(share * len(line))):
                if line[at] != " ":
                    line[at] = rng.choice("abcdefghij")
            rows.append((" ".join(words), "".join(line)))
    df = spark.createDataFrame(rows, "a string, b string")
    exact = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= 0.8
    got = df.select(lines._edit_similar(F.col("a"), F.col("b"), 0.8).alias("got"), exact.alias("want")).collect()
    assert all(bool(r.got) == r.want for r in got) and {r.want for r in got} == {True, False}


def test_long_lines_by_pieces_and_counts(spark):
    rng, rows = random.Random(77), []
    for i in range(16):
        words = prose(600, 400 + i).split()
        for j in rng.sample(range(600), rng.randint(30, 200)):
            words[j] = "".join(rng.choice("abcdéxyzß") for _ in range(rng.randint(1, 12)))
        rows.append((prose(600, 400 + i), " ".join(words)))
    rows += [("a" * 3000, "b" * 3000), ("a" * 3000, "a" * 2400 + "b" * 600), ("a" * 3000, "a" * 2399 + "b" * 601)]
    df = spark.createDataFrame(rows, "a string, b string")
    exact = F.levenshtein("a", "b") <= F.floor(F.greatest(F.length("a"), F.length("b")) * 0.2 + 1e-9)
    got = df.select(lines._edit_similar(F.col("a"), F.col("b"), 0.8).alias("got"), exact.alias("want"), F.length("a").alias("n")).collect()
    assert [r.got for r in got] == [r.want for r in got] and {r.got for r in got[:16]} == {True, False} and min(r.n for r in got) > lines.LONG
    assert [r.got for r in got[16:]] == [False, True, False]


def test_scales_turn_down_no_pair_that_counts_keep(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        words = prose(rng.choice([2, 6, 20, 90]), 900 + i).split()
        turned = [w if rng.random() < rng.choice([0.5, 0.8, 0.95]) else "ßx" + w[::-1] for w in words]
        rows.append((" ".join(words), " ".join(turned) if i % 3 else prose(len(words), 5000 + i)))
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string")
    counts = lines._counts_near(F.length(a), F.length(b), lines._counts(a), lines._counts(b), 0.8)
    scales = lines._scales_near(F.length(a), F.length(b), lines._scales(a), lines._scales(b), 0.8)
    near = [lines._edit_similar(a, b, 0.8, quick=quick) for quick in (True, False)]
    got = df.select(counts.alias("counts"), scales.alias("scales"), near[0].alias("near"), near[1].alias("direct")).collect()
    assert all(r.scales or not r.counts for r in got) and {r.scales for r in got} == {True, False}
    assert [r.near for r in got] == [r.direct for r in got] and {r.near for r in got} == {True, False}


def test_runs_of_lines_are_shuffled_once(spark):
    distinct = spark.createDataFrame([(1, prose(9, 1)), (2, prose(9, 1) + " x"), (3, prose(9, 2))], "node long, norm string")
    found = lines._members(distinct)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window") == 1 and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.node for r in found.collect()} == {1, 2} and set(found.columns) == {"bucket", "node", "len"}


def test_batches_of_documents_spread_over_buckets():
    for n in (4, 7, 8):
        assert len({pitman_yor.home(part << 32, n) for part in range(200)}) == n


def test_few_customers_are_seated_by_plain_weights():
    """Drawn with a uniform number a dish: against the weights' logarithms, a parent's too, and where plain weights overflow."""
    numbers, n = pitman_yor.Stirling(0.5), 40_000
    back = pitman_yor.Back(np.array([0.0, 3.0]), 0.2, 50.0, 0.5)
    for c, pull, dish in ((2, 30.0, 0), (6, 40.0, 1), (50, 25.0, 1)):
        weight = numbers.of(c, c) + np.cumsum(back.logs(np.array([dish]), c)[0] + math.log(pull))
        want = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
        one = pitman_yor.Back(np.full(n, back.value[dish]), back.new, back.seats, back.discount)
        drawn = np.ones(n, np.int64)
        left = pitman_yor._draw_few(drawn, np.arange(n), c, np.full(n, math.log(pull)), one, numbers, np.random.default_rng(3))
        assert not len(left) and np.abs(np.bincount(drawn, minlength=c + 1)[1:] / n - want).sum() / 2 < 0.015
    drawn = pitman_yor.draw_tables(np.full(9, 400), np.full(9, 30.0), pitman_yor.Flat(0.0), numbers, np.random.default_rng(4))
    assert (drawn > 395).all()
