import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobledger.llm import components, embeddings, queries

SMALL = "/root/testdata/sf0.001"


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, d))
    x = np.repeat(base, 4, axis=0) + rng.standard_normal((n // 4 * 4, d)) * rng.choice([0.1, 0.3, 0.36, 0.4], (n // 4 * 4, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize(("d", "unit"), [(64, 4096), (64, 40), (3, 4096)])
def test_embeddings_against_all_pairs(spark, monkeypatch, d, unit):
    monkeypatch.setattr(embeddings, "UNIT", unit)
    x = vectors(320, d, d)
    rows = [(k, v.tolist(), k // 100) for k, v in enumerate(x)]
    rows += [(400 + k, x[0].tolist(), 0) for k in range(5)] + [(500, None, 0), (501, [0.0] * d, 0), (502, [float("nan")] * d, 0), (503, [None] + [1.0] * (d - 1), 0), (504, x[0].tolist(), None), (505, [1.0] * (d + 1), 0), (506, [], 0), (507, [float("inf")] * d, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit("k"), "size": F.lit(1)})
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    link = {i: {j for j, w, m in good if j != i and m == lab and len(w) == len(v) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93} for i, v, lab in good}
    assert sum(map(len, link.values())) > 100
    for i, *_ in rows:
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in link.get(k, ()) if j not in seen and not seen.add(j)]
        r = got[i]
        assert (r.n_links, r.component_id, r.kept) == (len(link.get(i, ())), min(seen), i == min(seen)), i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids_of_embeddings(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [1.0, 0.1, 0.0]
    rows = [(7, x, 1), (7, x, 1), (7, y, 1), (5, near, 1), (None, y, 1), (None, [0.0, 0.0, 1.0], 1), (None, None, 1), (9, x, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"name": F.lit("n"), "root": F.lit(3), "v": F.lit(1.5)})
    got = sorted(map(str, embeddings.near_duplicates(df).collect()))
    want = [(7, 2, 5, False), (7, 2, 5, False), (7, 1, 7, True), (5, 2, 5, True), (None, 1, 7, False), (None, 0, None, False), (None, 0, None, False), (9, 0, 9, True)]
    assert got == sorted(f"Row(vec_id={a}, n_links={b}, component_id={c}, kept={d})" for a, b, c, d in want)


def test_the_pigeonhole_join_verifies_a_small_part_of_all_pairs_and_loses_none():
    x = vectors(2000, 64, 1).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cuts = embeddings.edges(64)
    limit = (2 - 2 * 0.93) * np.diff(cuts) / 64 + 1e-9
    pairs = {(min(p, q), max(p, q)) for u, v in embeddings.survivors(x @ embeddings.rotation(64), cuts, limit, np.zeros(len(x), int)) for p, q in zip(u.tolist(), v.tolist(), strict=True)}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(i) > 500 and set(zip(i.tolist(), j.tolist(), strict=True)) <= pairs
    assert len(pairs) < 0.005 * len(x) * (len(x) - 1) / 2


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HUBS", 8)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (-5, 130), (130, 129)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: -5 for k in range(100, 131)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_every_row_of_their_table(spark, name):
    found = queries.queries()[name](spark, SMALL)
    n = found.count()
    table = {"op7_embedding_dedup": "embeddings", "op10_url_filter": "pages"}.get(name, "documents")
    whole = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert n == whole if name not in ("op3_source_mix", "pipeline") else 0 < n <= whole


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids) > 0.8 * (docs.count() - len(toxic))
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        nothing = stage(spark, nothing, SMALL)
    assert nothing.count() == 0


def test_pipeline_drops_lines_of_small_sites(spark):
    texts = [f"own line {k}\nfooter of the site" for k in range(4)]
    docs = spark.createDataFrame([(k, t, "small", len(t)) for k, t in enumerate(texts)] + [(9, "alone\nalone too", "single", 15)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, "").collect()}
    assert got == {k: (f"own line {k}", 10) for k in range(4)} | {9: ("alone\nalone too", 15)}


def odd_documents(spark):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n))
    bench = [(1, say(12)), (None, say(11)), (3, None)]
    same = say(80)
    texts = [None, "", " \n ", "one", same, same, same.replace("w1 ", "w2 ", 1), say(50_000), f"{say(40)} {bench[0][1]} {say(30)}", bench[1][1], f"head\nfooter of all\n{say(60)}", f"other head\nfooter of all\n{say(70)}"]
    rows = [(k, t, "en" if k % 2 else None, "s" if k < 10 else "small", len(t or ""), "x", 1.5, "leaf", [1, 2]) for k, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, say(20), None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __toxicity string, score double, leaf string, h array<int>")
    return docs, texts, bench


def test_stages_take_whatever_documents_hold(spark, tmp_path):
    docs, texts, bench = odd_documents(spark)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == [*docs.columns, *(["copies"] if name == "source_mix" else [])], name
        seen[name] = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    plain = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert seen["toxicity"] == plain  # one class only: nothing is rejected
    counted = {s: sum(r.source == s for r in docs.collect()) for s in ("s", "small", None)}
    gone = {("s", same) for same in (texts[4],) if 3 > 0.05 * counted["s"]} | {("small", "footer of all"), ("s", texts[7])}
    source = {d: "s" if d is not None and d < 10 else "small" if d is not None else None for d, _ in plain}
    lines = lambda d, t: t if t is None else "\n".join(x for x in t.split("\n") if (source[d], x) not in gone)
    assert seen["line_dedup"] == sorted(((d, lines(d, t)) for d, t in plain), key=str)
    ids = [d for d, _ in seen["simhash_dedup"]]
    assert len(ids) == len(set(ids)) and 0 in ids and not {1, 2, 4, 5, 7} & set(ids) and {3, 8, 9, 10, 11} <= set(ids)
    clean = dict(seen["decontamination"])
    assert 9 not in clean and bench[0][1] not in clean[8] and all(clean[d] == t for d, t in seen["simhash_dedup"] if d not in (8, 9))
    assert set(seen["source_mix"]) <= set(seen["decontamination"]) and seen["source_mix"]


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_is_its_operators_one_after_the_other(spark):
    """Each stage of run() against the plain version of its operator, on what the stage before kept."""
    from jobledger.llm import linededup, mixing, simhash, toxicity

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))

    def toxic(text):
        buf = np.frombuffer((text or "").encode(), np.uint8)
        _, at = toxicity.gram_features(buf, np.array([0, len(buf)]), model.bits)
        return 1 / (1 + np.exp(-(sum(weight.get(k, 0.0) for k in set(at.tolist())) + model.bias))) >= 0.3

    left = {d: r.text for d, r in texts.items() if not toxic(r.text)}
    pages, seen = {}, {}
    for d, t in left.items():
        pages[texts[d].source] = pages.get(texts[d].source, 0) + 1
        for x in set((t or "").split("\n")):
            seen[texts[d].source, x] = seen.get((texts[d].source, x), 0) + 1
    bad = {k for k, n in seen.items() if n >= 2 and n > 0.05 * pages[k[0]] and k[1].strip(" ")}
    left = {d: "\n".join(x for x in t.split("\n") if (texts[d].source, x) not in bad) for d, t in left.items()}
    prints = {d: simhash.fingerprint(np.array(simhash.shingle_hashes(t.encode()), np.uint64)) for d, t in left.items()}
    group = {d: d for d in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if a < b and group[a] != group[b] and bin(prints[a] ^ prints[b]).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    left = {d: t for d, t in left.items() if group[d] == d}
    kept = docs
    found = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
        found.append({r.doc_id: r for r in kept.collect()})
    assert {d: r.text for d, r in found[2].items()} == left
    assert all(r.n_chars == len(r.text) for r in found[3].values())
    leaves = {}
    for d, r in found[3].items():
        leaves[d] = len(r.text.split())
    taken = sum(leaves[d] * r.copies for d, r in found[4].items())
    assert 0 <= taken - int(sum(leaves.values()) * 0.6) < 80 * max(leaves.values())
    assert {d: r.text for d, r in found[4].items()} == {d: found[3][d].text for d in found[4]}
    ran = {r.doc_id: (r.text, r.copies) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert ran == {d: (r.text, r.copies) for d, r in found[4].items()}
