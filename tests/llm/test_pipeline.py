"""The pipeline's stages, each against what its predecessor kept."""

import random

import corpus_pipeline
from millrace.llm import quality_rules
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_operators import brute_repeats


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = out
        if name != "best_fit_packing":
            assert sorted(out.columns) == sorted(docs.columns)
        if name == "quality_rules":
            judged = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: r["clean_text"] for i, r in judged.items() if r["kept"]}
        if name == "exact_dedup":
            largest = {}
            for i, t in before.items():
                key = "".join(c.lower() if c.isascii() else c for c in t)
                largest[key] = max(i, largest.get(key, i))
            assert {r["doc_id"] for r in out.collect()} == set(largest.values())
        if name == "simhash_near_dedup":
            assert ordered((r["doc_id"], r["text"]) for r in out.collect()) == ordered(brute_near(list(before.items())))
        if name == "suffix_array_dedup":
            want = brute_repeats(before)
            for r in out.collect():
                assert want[r["doc_id"]][0] - want[r["doc_id"]][1] <= len(r["text"].encode()) <= want[r["doc_id"]][0]
        docs = out
    assert kept["best_fit_packing"].select("doc_id").distinct().count() == kept["suffix_array_dedup"].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_exact(rows):
    best = {}
    for i, t in rows:
        key = "".join(c.lower() if c.isascii() else c for c in t)
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    return list(best.values())


def brute_near(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def ordered(rows):
    return sorted((i if i is not None else -1, t) for i, t in rows)


def test_exact_and_near_by_brute_force_with_repeated_and_null_ids(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = []
    for k in range(40):
        base = some(rng.choice((3, 30, 120)))
        rows += [(k, base), (rng.choice((None, k, 100 + k)), base.upper()), (rng.choice((None, k, 7)), base + " more"), (rng.choice((None, k)), some(20))]
    rows += [(k, t) for k, t in rows[:20]] + [(None, ""), (3, " "), (3, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).withColumns({c: F.lit(c) for c in ("row", "root", "_row", "best", "first", "sha", "id", "n")})
    for stage, brute in ((corpus_pipeline.exact, brute_exact), (corpus_pipeline.near, brute_near)):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert ordered((r["doc_id"], r["text"]) for r in out.collect()) == ordered(brute(rows))


def test_run_and_odd_rows(spark, tmp_path):
    (tmp_path / "d").mkdir()
    text = "Some plain words that make up a line which is long enough to be kept by all the rules we have."
    other = "Quite another line of words, which has nothing at all in common with those that stand above it here."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (4, text.upper(), "en", None, 1), (None, text + " More.", "en", "s", 1), (5, text + " More.", "en", "s", 1), (5, text + " More.", "en", "s", 1), (5, other, "en", "s", 1), (None, other + " And more of it, without any id, which makes the two differ in a good part of their words, as one sees.", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/d").collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 4, 5] and all(r["piece"] == 0 for r in got)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_exact_stage_drops_copies_without_id(spark):
    rows = [(3, "Same words"), (None, "same WORDS"), (1, "same words"), (None, "other words"), (None, "Other words"), (4, "alone")]
    left = corpus_pipeline.exact(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted((r["doc_id"] or 0, r["text"].replace("O", "o")) for r in left) == [(0, "other words"), (3, "Same words"), (4, "alone")]
