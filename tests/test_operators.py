"""Known answers on small inputs."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.sources import generators, reports, rest, tables
from tessera.operators import evaluation, faithfulness, fusion, graph, keyword, linking, normalize, querygen, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_prefers_frequent_and_rare_terms(spark):
    docs = frame(spark, [("A", "kinase kinase inhibitor pathway"), ("B", "kinase inhibitor pathway"), ("C", "antibody conjugate payload")], "doc_id string, text string")
    got = keyword.bm25(docs, frame(spark, [(1, "kinase")], "qid long, query string")).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["A", "B"]


def test_terms(spark):
    got = frame(spark, [("GLP-1 and IL6 modulation",), (None,)], "x string").select(t.terms(F.col("x")).alias("w")).collect()
    assert "glp" in got[0]["w"] and "il6" in got[0]["w"] and "1" not in got[0]["w"] and got[1]["w"] == []


def test_entity_keys_differ_beyond_ascii(spark):
    got = frame(spark, [("Müller, AG",)], "x string").select(t.entity_key(F.col("x")), t.surface_key(F.col("x"))).first()
    assert got[0] == "müller ag" and got[1] == "m ller ag"


def test_fusion(spark):
    lists = {"dense": [(1, "x", 1), (1, "y", 2)], "kw": [(1, "y", 1), (1, "z", 2)]}
    got = fusion.fuse({k: frame(spark, [(*r, 0.5) for r in v], "qid long, doc_id string, rank int, score double") for k, v in lists.items()}).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert score["y"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and score["x"] == pytest.approx(1 / 61, abs=1e-8) and score["z"] == pytest.approx(1 / 62, abs=1e-8)


def test_gate(spark):
    rows = frame(spark, [(1, "a", 0.9, 0.2, "s"), (2, "b", 0.9, 0.35, "s"), (3, "c", 0.9, 0.9, "")], "qid long, doc_id string, score double, text_score double, snippet string")
    got = {r["qid"]: r for r in fusion.gated(rows).collect()}
    assert "0.20" in got[1]["refusal"] and got[2]["refusal"] is None and got[3]["refusal"] == fusion.NOTHING and got[3]["confidence"] == 0.0


def test_ir_metrics(spark):
    ranking = frame(spark, [(1, "a", 1), (2, "b", 1), (2, "a", 2), (3, "b", 1)], "qid long, doc_id string, rank int")
    relevant = frame(spark, [(1, "a"), (2, "a"), (3, "a")], "qid long, doc_id string")
    got = {r["qid"]: r for r in evaluation.ir_metrics(ranking, relevant).collect()}
    assert (got[1]["mrr_10"], got[2]["mrr_10"], got[3]["mrr_10"]) == (1.0, 0.5, 0.0)
    assert got[2]["ndcg_10"] == pytest.approx(1 / math.log2(3), abs=1e-6) and got[3]["recall_50"] == 0.0


def test_signed_rank_and_verdict(spark):
    pairs = frame(spark, [("up", i, 0.0, 1.0) for i in range(8)] + [("same", i, 0.5, 0.5) for i in range(4)], "metric string, qid long, base double, cand double")
    got = {r["metric"]: r for r in evaluation.paired_delta(pairs, 200).collect()}
    assert got["up"]["delta"] == 1.0 and got["up"]["p"] < 0.05 and got["up"]["lo"] > 0
    assert got["same"]["delta"] == 0.0 and got["same"]["p"] == 1.0


def test_exact_tails_against_all_signs(spark):
    import itertools

    told = {(m, w): p for m, w, p in evaluation.exact_tails(8)}
    for m in (1, 4, 7):
        sums = [sum(i + 1 for i, up in enumerate(signs) if up) for signs in itertools.product((0, 1), repeat=m)]
        for w in range(m * (m + 1) // 4 + 1):
            assert told[m, w] == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**m))
    pairs = frame(spark, [("m", i, 0.0, (i + 1) / 10 * (-1 if i == 2 else 1)) for i in range(7)], "metric string, qid long, base double, cand double")
    assert evaluation.signed_rank(pairs).first()["p"] == pytest.approx(told[7, 3], abs=1e-6)
    z = frame(spark, [(x / 4,) for x in range(17)], "z double")
    assert all(r["p"] == pytest.approx(evaluation.p_value(r["z"]), abs=3e-7) for r in z.select("z", evaluation.normal_tails(F.col("z")).alias("p")).collect())


@pytest.mark.parametrize("pos,neg,auc", [([2.0, 3.0], [0.0, 1.0], 1.0), ([0.0], [1.0], 0.0), ([1.0], [1.0], 0.5), ([], [1.0], None)])
def test_auc(spark, pos, neg, auc):
    rows = [(x, True) for x in pos] + [(x, False) for x in neg]
    assert evaluation.roc_auc(frame(spark, rows, "score double, is_pos boolean")).first()["auc"] == auc


def test_split_is_exact(spark):
    edges = frame(spark, [(f"a{i}", f"b{i}", "r") for i in range(100)], "src string, dst string, rel string")
    got = graph.split_edges(edges)
    assert {r["part"]: r["count"] for r in got.groupBy("part").count().collect()} == {"train": 80, "val": 10, "test": 10}
    assert got.count() == got.select("src").distinct().count() == 100


def test_relational_mean_sums_over_relations(spark):
    edges = frame(spark, [("0", "1", "A"), ("0", "2", "B"), ("0", "3", "B")], "src string, dst string, rel string")
    h = frame(spark, [(str(i), 0, 1.0) for i in range(4)], "node_id string, dim int, value double")
    assert {r["node_id"]: r["value"] for r in graph.relational_mean(edges, h).collect()} == {"0": 2.0, "1": 0.0, "2": 0.0, "3": 0.0}


def test_linking(spark):
    nodes = frame(spark, [("organization:stanford", "organization", "Stanford"), ("organization:pfizer", "organization", "Pfizer"), ("organization:eli lilly", "organization", "Eli Lilly"), ("facility:pfizer medical center", "facility", "Pfizer Medical Center"), ("technology:1", "technology", "Pfizer")], "node_id string, ntype string, label string")
    queries = frame(spark, [(1, "work at stanford"), (2, "the lilly pipeline"), (3, "trial in pfizer medical center now"), (4, "medical center"), (5, "nothing")], "qid long, query string")
    got = sorted((r["qid"], r["node_id"]) for r in linking.link(queries, linking.surfaces(nodes)).collect())
    assert got == [(1, "organization:stanford"), (2, "organization:eli lilly"), (3, "facility:pfizer medical center")]


def test_inverted_text_and_parsers(spark):
    rows = frame(spark, [("https://x/W1", "T", {"b": [1], "a": [0, 2]}, None, None, "2024-01-01"), ("https://x/W2", "T", None, None, None, None)], "id string, title string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>, concepts array<struct<display_name:string>>, _retrieved_date string")
    got = normalize.openalex(rows).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == ["openalex:W1", "openalex:W2"] and [r["abstract"] for r in got] == ["a b a", ""] and got[0]["organizations"] == []
    patents = frame(spark, [("1", "t", "a", ['{"inventor_name_last": "Doe"}', "Roe", ""], None, None, None)], "patent_id string, patent_title string, patent_abstract string, inventors array<string>, assignees array<string>, cpc_codes array<string>, pharma_keywords array<string>")
    assert normalize.uspto(patents).first()["inventors"] == ["Doe", "Roe"]


def test_faithfulness(spark):
    rows = [("a", "binds kinase receptors", None, "kinase receptors binds well", ""), ("b", "cures everything tomorrow", None, "kinase", ""), ("c", "see http://x.org kinase", "http://y.org", "kinase", ""), ("d", "", None, "", "")]
    judged = faithfulness.judge(frame(spark, rows, "claim_id string, claim string, citation string, evidence string, context string"))
    got = {r["claim_id"]: r for r in judged.collect()}
    assert got["a"]["grounded"] and not got["b"]["grounded"] and got["c"]["bad_citations"] == 1 and got["d"]["support"] == 1.0
    assert faithfulness.rates(judged.filter("false")).first()["groundedness"] == 1.0


def test_embedding_is_deterministic_and_unit(spark):
    rows = frame(spark, [("cell therapy",), ("cell therapy",), (None,)], "x string")
    got = [np.array(r[0]) for r in rows.select(vectors.mock_embedding(64)("x")).collect()]
    assert np.allclose([np.linalg.norm(v) for v in got], 1.0, atol=1e-5) and (got[0] == got[1]).all()


def test_dense_topk_breaks_ties_by_id(spark):
    v = frame(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    got = vectors.dense_topk(v, frame(spark, [(9, [1.0, 0.0])], "qid long, embedding array<float>"), 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 3]


def test_parsed_array(spark):
    got = frame(spark, [('Sure: ["a", "b"] done',), ("none",)], "x string").select(querygen.parsed_array(F.col("x")).alias("a")).collect()
    assert got[0]["a"] == ["a", "b"] and not got[1]["a"]


def test_index_round_trip(spark, tmp_path):
    docs = frame(spark, [(f"d{i}", f"alpha beta gamma term{i}") for i in range(5)] + [("e", None)], "doc_id string, text string")
    queries = frame(spark, [(1, "alpha term3"), (2, "nothing")], "qid long, query string")
    index = keyword.build(docs)
    index.save(str(tmp_path / "index"))
    again = keyword.load(spark, str(tmp_path / "index"))
    assert (again.n, again.avgdl) == (6, pytest.approx(20 / 6))
    rows = [sorted(map(tuple, keyword.bm25(x, queries).collect())) for x in (docs, index, again)]
    assert rows[0] == rows[1] == rows[2] and min(rows[0], key=lambda r: r[3])[1] == "d3"


def test_texts_are_tokenised_once(spark):
    docs = frame(spark, [(1, "alpha beta"), (2, "beta")], "doc_id long, text string")
    lists = fusion.signals(docs, frame(spark, [(1, "beta")], "qid long, query string"))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in lists.values()]
    assert len(plans) == 2 and not any("lower(coalesce(text" in plan for plan in plans)  # what comes of the texts is read, not made again


def test_query_text_functions(spark):
    row = frame(spark, [('  "a  query\nof words" ', "Pyrimidin derivatives of Cancer-Drug use")], "q string, t string")
    got = row.select(t.norm_query(F.col("q")), t.plain_title_words(F.col("t")), t.instructed(F.lit("q"), "find")).first()
    assert got[0] == "a query of words" and got[1] == ["cancer-drug"] and got[2] == "Instruct: find\nQuery: q"


def test_graph_of_documents(spark):
    rows = [("b", "T", ["J. Doe"], ["Acme, Inc", "MIT"], ["x"], []), ("a", "", ["j doe"], ["acme inc"], [], ["Lab"])]
    docs = frame(spark, rows, "doc_id string, title string, inventors array<string>, organizations array<string>, experts array<string>, facilities array<string>")
    nodes, edges = graph.from_documents(docs)
    label = {r["node_id"]: r["label"] for r in nodes.collect()}
    assert label["technology:a"] == "a" and label["technology:b"] == "T" and label["inventor:j doe"] == "j doe" and label["organization:acme inc"] == "acme inc"
    got = {tuple(r) for r in edges.collect()}
    assert ("inventor:j doe", "organization:mit", "affiliated_with") in got and ("technology:a", "facility:lab", "located_at") in got
    assert not any(r[0].startswith("expert") for r in got) and len(got) == 9
    assert graph.known_edges(edges, nodes.filter("ntype <> 'facility'"), ["located_at", "assigned_to"]).count() == 3


def test_link_prediction(spark):
    unit = [[1.0 if i == j else 0.0 for j in range(8)] for i in range(8)]
    vectors_ = frame(spark, [("0", unit[0]), ("1", unit[0])] + [(str(i), unit[i]) for i in range(2, 6)], "node_id string, v array<double>")
    pairs = lambda rows: frame(spark, rows, "pid string, src string, dst string")
    others = frame(spark, [(i, str(i)) for i in range(6)], "i long, node_id string")
    positive = pairs([("p", "0", "1")])
    drawn = graph.ranking_negatives(positive, others, positive, wanted=4, tries=5)
    assert drawn.count() == 4 and not drawn.filter("dst IN ('0', '1')").count()
    got = graph.link_prediction(vectors_, positive, drawn.select("src", "dst"), drawn, 3).first()
    assert tuple(got) == (1, 1.0, 1.0, 1.0)
    none = graph.link_prediction(vectors_, pairs([]), drawn.select("src", "dst"), drawn, 3).first()
    assert tuple(none) == (0, None, None, None)


def test_graph_signal_abstains(spark):
    vectors_ = frame(spark, [("o", [1.0, 0.0]), ("t1", [0.9, 0.1]), ("t2", [0.1, 0.9])], "node_id string, v array<double>")
    nodes = frame(spark, [("o", None), ("t1", 1), ("t2", 2)], "node_id string, doc_id long")
    got = fusion.graph_search(frame(spark, [(7, "o"), (8, "unknown")], "qid long, node_id string"), vectors_, nodes).collect()
    assert [(r["qid"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 1), (7, 2)]
    assert tuple(fusion.fire_rate(frame(spark, [(7,), (8,)], "qid long"), frame(spark, [(7, "o")], "qid long, node_id string")).first()) == (2, 1, 0.5)


def test_recommendations_and_refusals(spark):
    rows = [(1, "a", 0.9, 0.8, "A", [], "text a", "s", "http://x/a"), (1, "b", 0.5, 0.4, "B", ["Acme"], "text b ", "s", "http://x/b"), (1, "c", 0.4, 0.4, "C", ["Acme"], "", "s", "http://x/c"), (2, "a", 0.1, 0.1, "A", [], "t", "s", "http://x/a")]
    cand = frame(spark, rows, "qid long, doc_id string, score double, text_score double, title string, organizations array<string>, snippet string, source string, source_url string")
    got = {r["qid"]: r for r in fusion.recommend(cand, frame(spark, [(1, "q"), (2, "r"), (3, "s")], "qid long, query string")).collect()}
    assert [r["doc_id"] for r in got[1]["recommendations"]] == ["b", "a"] and got[1]["num_expertise_gaps"] == 1 and got[1]["refusal"] is None
    assert got[1]["recommendations"][1]["why"] == "Relevant to 'q': A from an unnamed organization. Supporting evidence: \"text a...\" [source: http://x/a]"
    assert got[1]["recommendations"][0]["provenance"]["source"] == "s" and "0.10" in got[2]["refusal"] and got[2]["recommendations"] == []
    assert got[3]["refusal"] == fusion.NOTHING and got[3]["recommendations"] == []


def test_stability(spark):
    runs = frame(spark, [(0, 1, "a", 1), (0, 1, "b", 2), (1, 1, "b", 1), (1, 1, "a", 2), (2, 1, "a", 1), (2, 1, "b", 2), (0, 2, "x", 1)], "run int, qid long, doc_id string, rank int")
    got = {r["qid"]: tuple(r)[1:] for r in evaluation.retrieval_stability(runs).collect()}
    assert got[1] == (1.0, pytest.approx(-1 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6)) and got[2] == (1.0, 1.0, 1.0)
    told = frame(spark, [(0, 1, "p", ["u"], [1.0, 0.0]), (1, 1, "q", ["u", "v"], [0.0, 1.0]), (0, 2, "", [], [1.0, 0.0]), (1, 2, "", [], [1.0, 0.0])], "run int, qid long, prose string, citations array<string>, vector array<double>")
    claims = frame(spark, [(0, 1, True, 0), (1, 1, False, 1)], "run int, qid long, grounded boolean, bad_citations int")
    row = evaluation.explanation_stability(told, claims).first()
    assert (row["n"], row["answered"], row["refusal_rate"]) == (2, 1, 0.5)
    assert (row["exact_match_rate"], row["mean_semantic_equivalence"], row["citation_set_jaccard"]) == (0.5, 0.5, 0.75)
    assert (row["grounded"], row["citation_validity"], row["hallucination"]) == (0.5, 0.5, 0.5)
    none = evaluation.explanation_stability(told, claims.limit(0)).first()
    assert none["refusal_rate"] == 1.0 and none["grounded"] is None


def test_encoders(spark, tmp_path):
    texts = frame(spark, [(str(i), f"cell therapy number {i}") for i in range(7)], "doc_id string, text string")
    rows = evaluation.encoding_stability(texts, lambda size: vectors.encoder("mock", dim=64, batch=size).queries).collect()
    assert len(rows) == 3 and all(r["exact"] and r["max_cosine_drift"] == 0.0 for r in rows)
    stored = vectors.embedded(texts, vectors.encoder("mock", dim=64), "text")
    assert vectors.save_vectors(stored, texts, str(tmp_path / "v")) == 7 and vectors.load_vectors(spark, str(tmp_path / "v")).count() == 7
    with pytest.raises(ValueError):
        vectors.save_vectors(stored.limit(6), texts, str(tmp_path / "w"))
    with pytest.raises(RuntimeError):
        vectors.encoder("model", name="x", task="y")


def test_exact_topk_in_blocks(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(60, 6)), rng.normal(size=(23, 6))
    got = vectors.exact_topk(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>"), frame(spark, [(i, x.tolist()) for i, x in enumerate(q)], "qid long, q array<double>"), 4, block_bytes=500).collect()
    score = np.round(q @ v.T, 6)
    want = {(i, int(j), r + 1) for i in range(23) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:4])}
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in got} == want


def test_generated_records_are_parsed(spark):
    raw = generators.generated(spark, 30)
    again = generators.generated(spark, 30)
    for source, rows in raw.items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, again[source].collect()))
        assert normalize.PARSERS[source](rows).filter("title = '' OR abstract = '' OR size(organizations) = 0").count() == 0, source
    docs = normalize.normalized(raw)
    assert docs.count() == docs.select("doc_id").distinct().count() > 140 and docs.select("source").distinct().count() == 5
    assert normalize.normalized({"sbir": raw["sbir"]}, least=10_000).count() == 0
    names, edges = graph.from_documents(docs)
    assert graph.known_edges(edges, names).count() == edges.count()


def test_scans_and_sinks(spark, tmp_path):
    docs = normalize.normalized(generators.generated(spark, 5)).withColumn("extra", F.lit(None).cast("map<string,string>"))
    path = str(tmp_path / "docs")
    assert tables.write_jsonl(docs, path) == docs.count() == tables.read_docs(spark, path).count()
    (tmp_path / "odd.jsonl").write_text('{"doc_id": "a", "unknown": 1}\n\n')
    with pytest.raises(Exception, match="unknown"):
        tables.read_docs(spark, str(tmp_path / "odd.jsonl")).collect()
    nodes, edges = graph.from_documents(docs)
    counts = tables.write_graph(nodes, edges, graph.meta(nodes, edges), str(tmp_path / "graph"))
    a, b = tables.read_graph(spark, str(tmp_path / "graph"))
    assert counts == {"nodes": a.count(), "edges": b.count()} and sorted(map(str, b.collect())) == sorted(map(str, edges.collect()))
    qrels = frame(spark, [(1, "q", ["a", "b"])], "query_id long, query string, relevant_doc_ids array<string>")
    assert tables.write_qrels(qrels, str(tmp_path / "qrels")) == 1 and tuple(tables.read_qrels(spark, str(tmp_path / "qrels")).first()) == ("1", "q", ["a", "b"])
    raw = generators.generated(spark, 3, sources=["sbir"])["sbir"]
    tables.write_jsonl(raw, str(tmp_path / "sbir.jsonl"))
    assert set(tables.raw_records(spark, str(tmp_path))) == {"sbir"}
    assert {r["_retrieved_date"] for r in tables.stamped(raw, "2024-01-01").collect()} == {"2024-01-01"}
    text = reports.report(spark, "T", {"counts": graph.meta(nodes, edges)}, str(tmp_path / "r"), "2024")
    assert "| edge | located_at |" in text and (tmp_path / "r.json").exists()


def test_paged_service(spark):
    def get(url, headers):
        import json

        mark = int(url.rpartition("cursor=")[2]) if "cursor=" in url else 0
        return json.dumps({"results": [{"id": f"https://x/W{mark * 2 + i}", "title": "t"} for i in range(2)], "meta": {"next_cursor": str(mark + 1) if mark < 3 else None}}).encode()

    service = rest.Service("https://x/works", "results", {"per-page": "2"}, "meta.next_cursor", "cursor")
    got = rest.scan(spark, service, tables.RAW["openalex"], 5, get)
    assert sorted(r["id"] for r in got.collect()) == [f"https://x/W{i}" for i in range(5)]
    assert len(list(rest.pages(service, 100, get))) == 8
    assert rest.dropped_file(spark, "/tmp/tessera-no-such-file.jsonl", tables.RAW["autm"]) is None
    assert rest.patent_filter("2020-01-01", ["A61K", "A61P"])["_and"][1]["_or"][0] == {"cpc_current.cpc_subclass_id": "A61K"}


def test_lay_queries(spark):
    rows = [("d1", "Short", "x", None, [], "s", "u", "r"), ("d2", "Compositions comprising heteroaryl", "w " * 150, None, [], "s", "u", "r"), ("d3", "A title", "w", "e" * 250, ["gene editing"], "s", "u", "r")]
    docs = frame(spark, rows, "doc_id string, title string, abstract string, embedding_text string, keywords array<string>, source string, source_url string, retrieved_date string")
    got = querygen.templated(docs, per_doc=2, generated="2024").collect()
    assert {r["doc_id"] for r in got} == {"d2", "d3"} and len(got[0]) == 8 and max(r["query_index"] for r in got) == 1
    assert all("gene editing" in r["query"] or "{" not in r["query"] for r in got) and not any("heteroaryl" in r["query"] for r in got)
    assert {r["doc_id"] for r in querygen.templated(docs, max_docs=1).collect()} == {"d2"}


def test_eval_set_relaxes_its_bounds(spark):
    docs = frame(spark, [(i, f"compound{'abcdefghijklmnopqrst'[i]} potent selective inhibitor targeting kinase") for i in range(20)] + [(20, ""), (21, "unique words alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["query"] for r in querygen.eval_set(docs, 22).collect()}
    assert len(got) == 22 and "unique" in got[21] and "alone" in got[21] and got[20] == querygen.FRAMES[0].replace(" {}", "")


def test_first_edges_are_the_test_edges(spark):
    parts = [(frame(spark, [(i % 37, i) for i in range(n)] * 2, "s long, d long"), "a", "b", rel) for n, rel in ((900, "x"), (411, "y"))]
    with graph.Store(spark) as store:
        for share in (0.0, 0.0005, 0.1, 0.5):
            kept = graph.gathered(store, parts) if not share else kept
            test = graph.first_edges(kept, share)
            want = {tuple(r) for r in graph.split_edges(graph.edges(parts), 0.1, share).filter("part = 'test'").select("src", "rel", "dst").collect()}
            flat = [rows.select(graph.named("a", F.col("s")).alias("src"), F.lit(rel).alias("rel"), F.explode("near").alias("e")).withColumn("dst", graph.named("b", F.col("e.d"))) for rows, _, _, rel in kept]
            got = [tuple(r) for rows in flat for r in rows.filter(test(F.col("src"), F.col("rel"), F.col("dst"), F.col("e.b"))).select("src", "rel", "dst").collect()]
            assert len(got) == int(1311 * share) and set(got) == want


def test_first_edges_within_a_hash_value(spark):
    """Where the share ends among edges of one value of b, their order decides."""
    rows = frame(spark, [(i, [(i + 1, 7), (i + 2, 7)]) for i in range(10)], "s long, near array<struct<d:long,b:int>>")
    test = graph.first_edges([(rows, "a", "b", "x")], 0.25)
    flat = rows.select(graph.named("a", F.col("s")).alias("src"), F.explode("near").alias("e")).withColumn("dst", graph.named("b", F.col("e.d")))
    order = flat.select("src", "dst", graph.drawn(F.lit("13"), F.col("src"), F.lit("x"), F.col("dst")).alias("h")).orderBy("h").limit(5)
    got = flat.filter(test(F.col("src"), F.lit("x"), F.col("dst"), F.col("e.b"))).select("src", "dst")
    assert sorted(map(tuple, got.collect())) == sorted((r["src"], r["dst"]) for r in order.collect())


@pytest.mark.parametrize("n_left, n_right", [(50, 9), (4_000_000, 3_000_000_000)])
def test_dealt_draws_are_those_of_negatives(spark, n_left, n_right):
    keys = frame(spark, [(f"a:{i}|b:{i % 5}",) for i in range(40)], "key string")
    blocks, got = 3, []
    for r in graph.dealt_draws(keys, n_left, n_right, blocks, 3, 17, 16).collect():
        code = graph.unpacked([r["n"]], [bytes(r["draws"])])
        got += zip((code // n_right * blocks + r["block"]).tolist(), (code % n_right).tolist())
    draw = lambda side, n: F.conv(F.substring(graph.drawn(F.lit("17"), F.lit(side), "key", F.col("try").cast("string")), 1, 8), 16, 10).cast("long") % n
    want = keys.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(draw("u", n_left), draw("v", n_right))
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_one_of():
    rng = np.random.default_rng(3)
    have, x = np.unique(rng.integers(-5, 3000, 700)), rng.integers(-9, 3009, (40, 50))
    for part in (have, have[:1], have[:0], np.arange(40, 90)):
        assert (graph.one_of(part)(x) == np.isin(x, part)).all()
        at = graph.places_in(part, x)
        assert ((at >= 0) == np.isin(x, part)).all() and (part[at[at >= 0]] == x[at >= 0]).all()


def test_packed_counts():
    value = np.array([-9000, -4097, -4096, -1, 0, 5, 4095, 4096, 99999])
    p, c = np.arange(9), np.arange(9) + 1
    rows, got = graph.packed_counts("score", value, p, c), []
    for high in sorted(set(rows["high"].to_pylist())):
        one = rows.filter(graph.pa.compute.equal(rows["high"], high))
        got += graph.summed_counts(graph.pa.concat_tables([one, one])).to_pylist()
    assert [(r["value"], r["p"], r["c"]) for r in got] == list(zip(value.tolist(), (2 * p).tolist(), (2 * c).tolist()))
    assert not graph.packed_counts("better", value[:0], p[:0], c[:0]).num_rows
