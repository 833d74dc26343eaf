"""The pipeline stage by stage against plain Python, and odd input for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_removed, words

import corpus_pipeline
from ferrule.llm import chain_dedup, decontaminate, html_text, mixing, ngram_join, quality, secrets, sharding, suffix_dedup, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with labels, copies, benchmark passages, a hot source, nulls and repeated rows."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(14)
    docs = []
    for i in range(160):
        t = text(rnd.randint(25, 90))
        if i % 5 == 0:
            t = " ".join(w + "#$%" for w in t.split())  # bad: symbols
        if i % 16 == 1:
            t += " " + passage + " " + text(5)
        docs.append((i, t, ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 7}", len(t)))
    docs += [(200 + k, docs[k][1] + " end", "en", "hot", 9) for k in range(1, 160, 9)]  # near copies
    docs += [(300 + k, docs[2][1], "en", "hot", 9) for k in range(5)] + [docs[3], docs[3]]
    docs += [(400, None, None, None, None), (401, "", "en", "hot", 0), (None, text(40), "en", "hot", None), (402, "too short", "en", "hot", 9)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 160, 2)] + [(7, None, None), (None, 1, 0)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out), passage


def brute_mixture(spark, docs):
    """Copies of each row: leaves sorted by their seeded hash, whole epochs, then a prefix that fits."""
    hashes = {}
    leaves = {}
    rows = docs.withColumns(mixing.levels()).collect()
    for r in rows:
        leaves.setdefault((r.domain, r.lang or mixing.NONE, r.source or mixing.NONE), []).append((r.doc_id, len(words(r.text))))
    given = mixing.budgets(mixing.tree_of([(*k, sum(n for _, n in v)) for k, v in leaves.items()], mixing.WEIGHTS), sum(n for v in leaves.values() for _, n in v), 4)
    out = []
    for k, v in leaves.items():
        total = sum(n for _, n in v)
        whole, rest = divmod(given.get(k, 0), total) if total else (0, 0)
        ids = spark.createDataFrame([(i,) for i, _ in v], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(1), F.lit(whole).cast("long")).alias("h")).collect()
        hashes = {r.doc_id: r.h for r in ids}
        for i, _ in v:
            before = sum(n for j, n in v if hashes[j] <= hashes[i])
            out.append((i, whole + (before <= rest)))
    return sorted(out, key=repr)


def test_stages_against_brute_force(spark, folder):
    sf, passage = folder
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == names
        seen[name] = (docs.collect(), after.collect())
        docs = spark.createDataFrame(seen[name][1], SCHEMA)
    before, after = seen["quality rules"]
    rules = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    stats = quality.with_stats(spark.createDataFrame(before, SCHEMA)).collect()
    assert rules and sorted((r.doc_id or -1) for r in after) == sorted((r.doc_id or -1) for r in stats if not r.base_failed and not any(x.covers(r.asDict()) for x in rules))
    assert not any(r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 160 for r in after) and len(after) > 100
    before, after = seen["n-gram Jaccard join"]
    groups = brute_components([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({i for i, (_, c) in groups.items() if c == i})
    before, after = seen["benchmark decontamination"]
    windows = [" ".join(passage.split()[k : k + 10]) for k in range(5)]
    assert sorted(repr(r.doc_id) for r in after) == sorted(repr(r.doc_id) for r in before if not any(w in r.text for w in windows)) and len(after) < len(before)
    before, after = seen["mixing to target weights"]
    want = [i for i, n in brute_mixture(spark, spark.createDataFrame(before, SCHEMA)) for _ in range(n)]
    assert sorted(map(repr, want)) == sorted(repr(r.doc_id) for r in after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(repr(r.doc_id) for r in last) == sorted(map(repr, want))
    check_shards(last, 40)
    assert sorted(repr(tuple(r)[:3]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(repr(tuple(r)[:3]) for r in last)


def check_shards(rows, shards):
    """Sizes near equal: no shard is above the mean by more than its largest document; slots are gapless."""
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    mean = sum(r.size for r in rows) / shards
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        assert sum(r.size for r in v) <= mean + max(r.size for r in rows)


def test_shards_are_even_and_moves_are_least(spark):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, "x" * rnd.randint(50, 300)) for i in range(4000)] + [(9000, "y" * 5000)] * 30, "doc_id long, text string")
    old = F.pmod(F.col("doc_id"), F.lit(4)).cast("int")
    rows = sharding.digest(sharding.reshard(docs, 4, old)).collect()
    check_shards(rows, 4)
    load, size = {}, {}
    for r in rows:
        load[r.old_shard] = load.get(r.old_shard, 0) + r.size
        size[r.shard] = size.get(r.shard, 0) + r.size
    total = sum(load.values())
    assert max(size.values()) - min(size.values()) <= total / 4 / 100  # repeated big rows are spread too
    moved = sum(r.size for r in rows if r.old_shard != r.shard)
    least = sum(max(0, b - total / 4) for b in load.values())
    assert moved <= 1.05 * least + 10_000


def test_mixing_rows_against_sorting(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    got = sorted(((r.doc_id, r.copies) for r in mixing.mixture(docs).select("doc_id", "copies").collect()), key=repr)
    assert got == brute_mixture(spark, docs)


def clashing(spark, rows):
    """Columns with the names of intermediate results beside the real ones."""
    extra = ["n", "fp1", "key", "m", "t1", "spans", "kept", "shard", "slot", "size", "n_tokens", "copies", "n_words", "start", "host", "d", "words"]
    return spark.createDataFrame([(*r, *["z"] * len(extra)) for r in rows], SCHEMA + ", " + ", ".join(f"{c} string" for c in extra))


ROWS = [(1, "a b c d e f g h i j k l", "en", "s", 3), (1, "a b c d e f g h i j k l", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x y z", "en", None, 1), (4, "word " * 30_000, "de", "s", 9)]


@pytest.mark.parametrize("rows", [[], ROWS], ids=["empty", "odd"])
def test_operators_on_odd_tables(spark, rows, tmp_path):
    import public_tokenizers

    df, n = clashing(spark, rows), len(rows)
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (None, "x y z")], "item_id long, text string")
    joined = ngram_join.ngram_join(df).collect()
    assert len(joined) == n and all(r.component_id == r.doc_id for r in joined)
    token_files.write_tokens(df.where("doc_id is not null"), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    assert token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "t"))).count() == sum(r[0] is not None for r in rows)
    assert mixing.mixture(df).count() == n
    assert chain_dedup.passages(df).where("doc_id <> 4").count() == 0
    assert quality.judged(df, []).count() == n
    found = secrets.scan(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(found) == n and all(r.n_assign == r.n_access == r.n_hex == 0 for r in found)
    marked = decontaminate.decontaminate(df, items).collect()
    assert len(marked) == n and [r.contaminated for r in marked if r.doc_id == 1] == [True] * min(2, n)
    assert decontaminate.decontaminate(df, items.limit(0)).where("contaminated").count() == 0
    assert sharding.reshard(df, 4, sharding.old_by_hash()).count() == n
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df, 20, 8).collect()}
    assert got == {i: v[1] for i, v in brute_removed([r[:2] for r in rows], 20).items()}
    docs = df.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    for _, stage in corpus_pipeline.STAGES:
        sf = tmp_path / f"sf-{stage.__name__}"
        items.write.parquet(str(sf / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        assert stage(spark, docs, str(sf)).count() <= 4 * n


def test_pages_that_are_empty_deep_and_unlike(spark):
    deep = "<body>" + "<div>" * 3000 + "inside"
    page = lambda k, d: "" if d == 0 else f"<div><p>{k} {d}</p>" + ("<ul></ul>" if (d + k) % 2 else "<ol></ol>") + page(k, d - 1) + "</div><div class=b></div>"
    rows = [(1, "http://d.example/1", deep), (2, "http://d.example/2", deep + " too"), (3, None, None), (4, "", ""), *[(10 + k, f"http://u.example/{k}", page(k, 30)) for k in range(4)]]
    rows += [(20, "http://x.example/", "<main><p class='share price'>Up</p><p class='notice'>No</p><div class='share-box'>no</div></main>")]
    got = {r.page_id: r.text for r in html_text.extract_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "inside" and got[3] == got[4] == "" and got[11].startswith("1 30\n1 29") and got[20] == "Up"
    assert html_text.extract_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_matched(a, b):
    """Simple tree matching as it is defined."""
    best = [[0] * (len(b[3]) + 1) for _ in range(len(a[3]) + 1)]
    for i, x in enumerate(a[3]):
        for j, y in enumerate(b[3]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (brute_matched(x, y) if x[0] == y[0] else 0))
    return 1 + best[-1][-1]


def test_tree_matching_against_its_definition():
    rnd = random.Random(4)

    def tree(depth):
        return [rnd.choice("ab"), [], [1], [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else []]

    for _ in range(150):
        a, b = tree(3), tree(3)
        a[0] = b[0] = "r"
        alike = [x[0] for x in a[3]] == [x[0] for x in b[3]]
        assert html_text.matched(a, b) <= brute_matched(a, b) and (alike or html_text.matched(a, b) >= 1)
        assert html_text.unpacked(html_text.packed(a)) == a


def test_secret_scan_rows(spark):
    import public_tokenizers

    rows = [(1, "token: abcdef " + "0f" * 13), (1, "token: abcdef " + "0f" * 13), (2, None), (3, "kQ9zX2vLr8TnB4mWc7Yp3Hd6 internationalization")]
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect())
    assert got == [(1, 1, 0, 1, "assign:0:13,hex:14:40")] * 2 + [(2, 0, 0, 0, ""), (3, 0, 0, 0, "random:0:24")]


def test_one_shared_passage_in_many_tasks(spark):
    line = " ".join(f"p{k}" for k in range(60))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = chain_dedup.passages(spark.createDataFrame([(1, f"u v {line} w"), (2, f"x {line} y z"), (3, "alone")], "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.doc_id, r.ref_doc_id, r.start, r.end, r.n_equal) for r in found] == [(2, 1, 1, 61, 60)]


def test_rows_of_one_id_with_different_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (0, b)]
    assert {r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
