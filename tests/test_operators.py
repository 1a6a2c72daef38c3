import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.functions.vectors import hashing_embedding
from signalweave.operators import convergence as cv
from signalweave.operators import digest as dg
from signalweave.operators import enrich, events, feeds, graph, intake, pruned_join
from signalweave.params import Params
from signalweave.sources import registry

T0 = dt.datetime(2026, 6, 18)


def test_recency_cap(spark):
    rows = [(i, "s", T0 - dt.timedelta(days=i)) for i in range(200)] + [(900, "u", None)]
    df = spark.createDataFrame(rows, "item_id int, source_name string, published_at timestamp")
    got = [r.item_id for r in intake.recency_cap(df, F.lit(T0), 14, 10).collect()]
    assert sorted(got) == [*range(10), 900]
    assert intake.recency_cap(df, F.lit(T0), 0, 500).count() == 201


def test_reload_adds_nothing(spark):
    df = spark.createDataFrame([(1, "s", "u1", "T", None, "x"), (2, "s", "u1", "t ", None, "y"), (3, "r", "u2", "T", None, "x")], "item_id int, source_name string, url string, title string, published_at timestamp, summary string")
    keyed = intake.with_keys(df)
    first = intake.new_items(keyed, keyed.limit(0))
    assert sorted(r.item_id for r in first.collect()) == [1, 3]  # the same story from two sources stays twice
    assert intake.new_items(keyed, first).count() == 0


def _sequential(items, threshold):
    """The rule item by item: events by hash, else the most similar earlier first-of-its-hash item, else new."""
    seen, event, firsts = {}, {}, []
    for i, at, h, v in sorted(items, key=lambda x: (x[1], x[0])):
        if h in seen:
            event[i] = event[seen[h]]
            continue
        seen[h] = i
        best = max(((round(float(v @ w), 9), -n, j) for n, (j, w) in enumerate(firsts)), default=(-2, 0, None))
        event[i] = event[best[2]] if best[0] >= threshold else i
        firsts.append((i, v))
    return event


def test_events_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    items = []
    for i in range(80):
        v = centres[rng.integers(6)] + rng.standard_normal(16) * 0.6
        items.append((i, int(rng.integers(40)), f"h{rng.integers(60)}", v / np.linalg.norm(v)))
    by_hash = {}
    items = [(i, at, h, by_hash.setdefault(h, v)) for i, at, h, v in items]
    df = spark.createDataFrame([(i, at, h, v.tolist()) for i, at, h, v in items], "id long, at long, content_hash string, vec array<double>")
    got = {r.id: r.event_id for r in events.assign(df, 0.7).collect()}
    assert got == _sequential(items, 0.7)
    assert len(set(got.values())) > 5


@pytest.mark.parametrize("sizes", [(2048, 8192, 512, 1024), (7, 31, 20, 10)])
def test_pruned_join_finds_what_all_pairs_give(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "LEFT", "CELL_ROWS", "RANGE_ROWS"), sizes):
        monkeypatch.setattr(pruned_join, name, size)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((60, 40)), rng.standard_normal((6, 40))[rng.integers(6, size=140)] + 0.25 * rng.standard_normal((140, 40))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[70], v[90] = v[66], v[66]  # ties go to the earliest
    v[5] *= 3.0  # lengths other than 1
    v[6] = 0.0
    at = rng.integers(0, 50, len(v))
    df = spark.createDataFrame([(i, int(at[i]), x.tolist()) for i, x in enumerate(v)], "id long, at long, vec array<double>")
    s = np.round(v @ v.T, 9)
    want = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.8]
    assert sorted((r.a, r.b) for r in pruned_join.similar_pairs(df, 0.8).collect()) == want
    order = sorted(range(len(v)), key=lambda i: (at[i], i))
    place = {i: n for n, i in enumerate(order)}
    near = {r.id: (r.parent, r.similarity) for r in pruned_join.best_earlier(df, 0.8).collect()}
    for i in range(len(v)):
        hits = [(-s[i, j], place[j], j) for j in order[: place[i]] if s[i, j] >= 0.8]
        assert near.get(i) == ((min(hits)[2], -min(hits)[0]) if hits else None)
    told = pruned_join.work(df, 0.8).first()
    assert told.pairs == 200 * 199 // 2 and len(near) <= told.candidates <= told.bounded <= told.pairs
    if sizes[0] == 7:
        assert told.bounded < told.pairs
    assert pruned_join.best_earlier(df.limit(0), 0.8).count() == 0


def test_near_duplicates_by_text(spark):
    rows = ["acme releases fast model today", "acme releases fast model", "today acme releases fast model", "rain expected in the north", "markets fall on rate fears"]
    df = spark.createDataFrame([(i, i, t, t) for i, t in enumerate(rows)], "id long, at long, content_hash string, t string").withColumn("vec", hashing_embedding("t", 256))
    assert len({r.event_id for r in events.assign(df, 0.6).collect()}) == 3
    assert len({r.event_id for r in events.assign(df, use_vectors=False).collect()}) == 5


def _graph(spark, mentions):
    """mentions: (entity, event, source)."""
    items = [(n, s, e) for n, (_, e, s) in enumerate(mentions)]
    m = spark.createDataFrame([(n, x, T0) for n, (x, _, _) in enumerate(mentions)], "item_id long, entity_id long, ts timestamp")
    i = spark.createDataFrame(items, "item_id long, source_name string, event_id long")
    r = spark.createDataFrame([(e, x, x + 100, T0) for x, e, _ in mentions], "event_id long, subject long, object long, ts timestamp")
    names = spark.createDataFrame([(x, f"E{x}") for x in sorted({x for x, _, _ in mentions} | {x + 100 for x, _, _ in mentions})], "entity_id long, name string")
    return names, m, i, r


def _signals(spark, mentions, now="2026-06-20", p=Params()):
    now = F.lit(now).cast("timestamp")
    names, m, i, r = _graph(spark, mentions)
    edges = r.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "ts")
    since = now - F.make_dt_interval(F.lit(p.window_days))
    scored = cv.contributions(cv.convergence(names, m, i, edges, since), r, p)
    ev = i.select("event_id").distinct()
    return {s.event_id: s for s in cv.signals(ev, r, scored, now, p).collect()}


HUB = [(1, e, f"S{e % 3}") for e in range(1, 7)]
RARE = [(2, 11, "S1"), (2, 12, "S2")]
FILL = [(50 + e, e, "S9") for e in range(20, 30)]


def test_a_rare_entity_beats_a_hub(spark):
    s = _signals(spark, HUB + RARE + FILL)
    assert s[11].score > s[1].score and s[11].driver == "E2" and sorted(s[11].evidence_sources) == ["S1", "S2"]
    assert s[11].why.startswith("convergence: 'E2' across 2 independent sources in 2 developments")
    assert s[20].driver is None and s[20].why == "" and s[20].convergence == 0


def test_one_source_is_no_claim(spark):
    s = _signals(spark, [(1, e, "S1") for e in range(4)] + FILL)
    assert s[0].convergence == 0 and s[0].why == ""


def test_nothing_outside_the_window(spark):
    s = _signals(spark, HUB + RARE, "2027-01-01", Params(window_days=1))
    assert {x.score for x in s.values()} == {0.0}


def test_convergence_of_events_is_that_of_their_mentions(spark):
    r = random.Random(8)
    items = [(n, r.randrange(6), r.choice(["a", "b", "c", None]), r.choice([None, *[T0 + dt.timedelta(days=d) for d in range(6)]])) for n in range(40)]
    ends = sorted({(r.randrange(7), r.randrange(5)) for _ in range(20)})
    names = spark.createDataFrame([(x, f"E{x}") for x in range(6)], "entity_id long, name string")
    i = spark.createDataFrame(items, "item_id long, event_id long, source_name string, published_at timestamp")
    e = spark.createDataFrame(ends, "event_id long, entity_id long")
    edges = spark.createDataFrame([(1, 2, T0), (2, 3, None)], "src long, dst long, ts timestamp")
    mentions = i.join(e, "event_id").select("item_id", "entity_id", F.col("published_at").alias("ts"))
    for since in (None, F.lit(T0 + dt.timedelta(days=2))):
        a = cv.convergence(names, mentions, i, edges, since)
        b = cv.convergence_of_events(names, e, i, edges, since)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_degree_counts_pairs(spark):
    e = spark.createDataFrame([(1, 2, T0), (1, 2, T0), (2, 1, T0), (3, 3, T0)], "src long, dst long, ts timestamp")
    assert {r.entity_id: r.degree for r in cv.degrees(e).collect()} == {1: 2, 2: 2, 3: 1}


def test_projection(spark):
    ev = spark.createDataFrame([(1, "t", "archive", "c", [" Big Tag "], 10), (2, "none", "archive", "c", [], 99)], "event_id long, title string, priority_class string, category string, tags array<string>, representative_item_id long")
    it = spark.createDataFrame([(10, 1, 5, "Src", "rss", "t", "u", T0)], "item_id long, event_id long, source_id long, source_name string, source_type string, title string, url string, published_at timestamp")
    rel = spark.createDataFrame([(1, 1, 7, "uses", 8, T0)], "id long, event_id long, subject long, predicate string, object long, ts timestamp")
    en = spark.createDataFrame([(7, "A", "org"), (8, "B", "alien")], "entity_id long, name string, type string")
    nodes, edges = graph.project(ev, it, rel, en)
    assert nodes.count() == 6 and {tuple(r.labels) for r in nodes.where("label = 'Entity'").collect()} == {("Entity", "Org"), ("Entity",)}
    assert sorted(r.rel for r in edges.collect()) == ["ABOUT", "FROM", "INTERACTS_WITH", "IN_EVENT", "MENTIONS", "MENTIONS"]
    assert graph.merged_nodes(nodes.withColumn("at", F.lit(1)).unionByName(nodes.withColumn("at", F.lit(0)))).count() == 6
    assert graph.checked(nodes, edges).count() == 0 and graph.checked(nodes.withColumn("label", F.lit("Odd")), edges).first().n == 6


def test_entity_cap_and_resolution(spark):
    rows = [(1, 1, [("OpenAI", "org"), ("openai ", "org")] + [(f"x{i}", "tool") for i in range(20)])]
    df = spark.createDataFrame(rows, "event_id long, at long, entities array<struct<name:string,type:string>>")
    each, named = graph.resolved_entities(df, 5)
    assert each.count() == 5 and {r.normalised_name: r.name for r in named.collect()}["openai"] == "OpenAI"
    rel = spark.createDataFrame([(1, "OPENAI", "makes", "x0"), (1, "x0", "is", "x19")], "event_id long, subject string, predicate string, object string")
    assert [r.object for r in graph.resolved_relations(each, rel).collect()] == ["x0"]


def test_feedback_latest_wins(spark):
    log = spark.createDataFrame([(1, 1, "ignore", T0), (2, 1, "useful", T0), (3, 2, "ignore", T0), (4, 3, "odd", T0)], "id long, event_id long, action string, created_at timestamp")
    got = {r.event_id: (r.weight, r.hidden) for r in feeds.feedback_state(log).collect()}
    assert got == {1: (1.0, False), 2: (-1.0, True), 3: (0.0, False)}


def test_class_is_never_crossed(spark):
    rows = spark.createDataFrame([(1, 3, 0, 0, 0, 5, "operational_update"), (2, 2, 5, 5, 4, 0, "horizon_signal"), (3, 3, 5, 0, 0, 0, "operational_update")], "event_id long, relevance int, novelty int, actionability int, strategic_potential int, hype int, priority_class string")
    boost = spark.createDataFrame([(2, 99.0)], "event_id long, score double")
    assert [r.event_id for r in feeds.ranked(rows, boost).collect()] == [3, 1, 2]


def test_star_velocity(spark):
    df = spark.createDataFrame([(1, "a", 80, T0), (2, "a", 100, T0 + dt.timedelta(1)), (3, "b", 50, T0), (4, "b", 50, T0 + dt.timedelta(1)), (5, "c", 9, T0), (6, "c", 5, T0 + dt.timedelta(1))], "id long, repo string, stars long, captured_at timestamp")
    assert [r.title for r in feeds.star_velocity(df).collect()] == ["a gained 20 stars (now 100)"]


def test_answers(spark):
    good = '{"category": "c", "tags": [" a ", ""], "scores": {"relevance": 1, "novelty": 2, "actionability": 3, "strategic_potential": 4, "hype": 0}}'
    texts = [good, f"```json\n{good}\n```", f"Sure: {good} bye", '{"a": "}"} ' + good, good.replace('"hype": 0', '"hype": 9'), "garbage", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.ok for r in enrich.classified(df).orderBy("i").collect()] == [True, True, True, False, False, False, False]
    lax = ['{"scores": %s}' % ('{"relevance": %s, "novelty": 2, "actionability": 3, "strategic_potential": 4, "hype": 0}' % x) for x in ('"4"', "4.0", "true", '" 3 "', "2.5", "null", "[1]", "-1", '"x"')]
    df = spark.createDataFrame(list(enumerate(lax)), "i int, text string")
    assert [r.relevance for r in enrich.classified(df).orderBy("i").collect()] == [4, 4, 1, 3, None, None, None, None, None]
    tags = ['{"a": 1}', "7", "null", '"[wip] x"', '[1, "a ", true, null, ""]']
    df = spark.createDataFrame([(i, good.replace('[" a ", ""]', t)) for i, t in enumerate(tags)] + [(5, good.replace('"c"', "null")), (6, good.replace('"c"', "3"))], "i int, text string")
    assert [(r.ok, r.tags) for r in enrich.classified(df).orderBy("i").collect()] == [(True, []), (True, []), (True, []), (True, ["[wip] x"]), (True, ["1", "a", "True", "None"]), (False, ["a"]), (False, ["a"])]
    g = spark.createDataFrame([('{"entities": [{"name": "A", "type": "org"}], "relationships": []}',), ('{"entities": [{"name": "A", "type": "alien"}]}',), ('{"entities": [{"name": " ", "type": "org"}]}',)], "text string")
    assert [(r.ok, len(r.entities)) for r in enrich.graph_payload(g).collect()] == [(True, 1), (False, 0), (False, 0)]


def test_fallback_where_an_answer_is_bad(spark):
    items = spark.createDataFrame([(1, "Python security release", "s", "rss"), (2, "Weather", None, "arxiv")], "event_id long, title string, summary string, source_type string")
    good = '{"scores": {"relevance": 5, "novelty": 2, "actionability": 3, "strategic_potential": 4, "hype": 0}}'
    c = spark.createDataFrame([(1, "no"), (2, good)], "event_id long, text string")
    s = spark.createDataFrame([(1, '{"summary": "x"}'), (2, '{"summary": "y"}')], "event_id long, text string")
    got = {r.event_id: r for r in enrich.enriched(items, c, s).collect()}
    assert got[1].method == "fallback" and got[1].category == "security" and got[1].tags == ["python"] and got[1].actionability == 2
    assert got[2].method == "llm" and got[2].summary == "y" and got[2].priority_class == "immediate_priority"


def test_registry(spark):
    cols = "pos int, name string, source_type string, url string, repo_owner string, repo_name string, arxiv_query string, trust_level string"
    df = spark.createDataFrame([(0, "a", "rss", "u", None, None, None, "high"), (1, "b", "github_releases", "u", "o", None, None, "low"), (2, " ", "odd", "", None, None, None, None)], cols)
    valid, errors = registry.checked(df)
    assert [r.name for r in valid.collect()] == ["a"]
    assert {(r.pointer, r.message) for r in errors.collect()} == {("entry #1 (b)", "github_releases needs repo_owner and repo_name"), ("entry #2", "name must not be blank"), ("entry #2", "url must not be blank"), ("entry #2", "unknown source_type"), ("entry #2", "unknown trust_level")}


def test_digest_routing(spark):
    rows = [
        (1, "immediate_priority", 1, "misc", ["x"], "rss", "act", 3.0, 0), (2, "operational_update", 1, "release", [], "github_releases", "act", 0.0, 0),
        (3, "horizon_signal", 1, "paper", [], "arxiv", "", 5.0, 2), (4, "horizon_signal", 1, "misc", [], "rss", "", 0.0, 0),
        (5, "archive", 1, "misc", [], "github_advisories", "", 0.0, 0), (6, "immediate_priority", 5, "cve", [], "rss", "act", 0.0, 0),
    ]
    df = spark.createDataFrame([(e, c, 3, 3, 3, 4, h, cat, t, st, a, s, k, None) for e, c, h, cat, t, st, a, s, k in rows], "event_id long, priority_class string, relevance int, novelty int, actionability int, strategic_potential int, hype int, category string, tags array<string>, source_type string, recommended_action string, score double, convergence int, theme_relevance double")
    got = {}
    for r in dg.sections(df).orderBy("section", "pos").collect():
        got.setdefault(r.section, []).append(r.event_id)
    assert got == {"must_know": [1], "should_read": [2], "weak_signals": [3], "research_radar": [3], "tool_changes": [2], "risks": [6, 5], "opportunities": [1, 2, 3, 4], "suggested_experiments": [1, 2]}
    c = dg.digest_counts(df, dg.sections(df)).first()
    assert (c.total_events, c.item_count, c.noise_count, c.event_ids) == (6, 4, 2, [1, 2, 3, 4, 5, 6])


def test_period_falls_back_to_all(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 - dt.timedelta(90)), (3, None)], "event_id long, published_at timestamp")
    ids = lambda now: sorted(r.event_id for r in dg.in_period(df, F.lit(now).cast("timestamp"), 7).collect())
    assert ids("2026-06-20") == [1, 3] and ids("2027-06-20") == [1, 2, 3]


def test_roots_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    forest = spark.createDataFrame([(i, max(0, i - 1)) for i in order], "id long, parent long")
    assert {r.root for r in events.roots(forest).collect()} == {0}


def test_sketches_are_exact_for_small_counts(spark):
    """3,000 events and sources of one entity, and many entities of two events each: no estimate is off."""
    ends = spark.range(3000).select(F.col("id").alias("event_id"), F.explode(F.array(F.lit(-1), F.expr("id div 2"))).alias("entity_id"))
    items = spark.range(3000).select(F.col("id").alias("event_id"), F.concat(F.lit("s"), "id").alias("source_name"), F.expr("timestamp '2001-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))").alias("published_at"))
    got = cv.sketched_windows(cv.daily_sketches(ends, items), ["2001-03-02"], 60).collect()
    assert {(r.entity_id == -1, r.distinct_sources, r.event_count) for r in got} == {(True, 3000, 3000), (False, 2, 2)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_into_a_node_are_counted_in_one_exchange(spark):
    from signalweave.plans.queries import _edge_counts

    edges = spark.range(9).select(F.lit("MENTIONS").alias("rel"), F.lit("Entity").alias("dst_label"), F.expr("cast(id % 2 as string)").alias("dst_uid"), F.col("id").cast("string").alias("src_uid"), F.lit(T0).alias("ts"))
    out = _edge_counts(edges)
    assert _plan(out).count("Exchange") == 1 and sorted((r.dst_uid, r.n, r.sources) for r in out.collect()) == [("0", 5, 5), ("1", 4, 4)]


def test_narrow_rows_are_spread_by_their_number(spark, monkeypatch):
    from signalweave import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    assert tables.spread(spark.range(95), "id").rdd.getNumPartitions() == 10


def test_sources_are_joined_to_one_driver_an_event(spark):
    scored = spark.createDataFrame([(1, "a", 2.0, 2, 3, T0, 2, 1.0, ["x", "y"]), (2, "b", 0.0, 1, 1, T0, 2, 1.0, ["x"])], "entity_id long, name string, contribution double, distinct_sources long, degree long, last_ts timestamp, event_count long, idf double, source_names array<string>")
    rel = spark.createDataFrame([(10, 1, 2), (11, 2, 2)], "event_id long, subject long, object long")
    out = cv.signals(spark.range(10, 13).select(F.col("id").alias("event_id")), rel, scored, F.lit(T0))
    assert not [a for a in _plan(out).splitlines() if "Aggregate" in a and "source_names" in a]
    assert {r.event_id: (r.score, r.driver, r.evidence_sources) for r in out.collect()} == {10: (2.5, "a", ["x", "y"]), 11: (0.5, None, []), 12: (0.0, None, [])}


def test_only_topic_nodes_are_merged(spark):
    ev = spark.createDataFrame([(1, "t", "archive", "misc", ["a", "A "], 5)], "event_id long, title string, priority_class string, category string, tags array<string>, representative_item_id long")
    it = spark.createDataFrame([(5, 1, 7, "S", "rss", "i", "u", T0)], "item_id long, event_id long, source_id long, source_name string, source_type string, title string, url string, published_at timestamp")
    rel = spark.createDataFrame([(9, 1, 3, "p", 4, T0)], "id long, event_id long, subject long, predicate string, object long, ts timestamp")
    en = spark.createDataFrame([(3, "x", "org"), (4, "y", "concept")], "entity_id long, name string, type string")
    nodes = graph.project(ev, it, rel, en)[0]
    assert sorted((r.label, r.uid, r.labels) for r in nodes.collect()) == [("Entity", "3", ["Entity", "Org"]), ("Entity", "4", ["Concept", "Entity"]), ("Event", "1", ["Event"]), ("Item", "5", ["Item"]), ("Source", "7", ["Source"]), ("Topic", "a", ["Topic"])]
    assert not [a for a in _plan(nodes).splitlines() if "SortAggregate" in a and "published_at" in a and "Topic" not in a and "Item" in a]
    assert len(graph.changes(ev, it, rel, en)[0]) == 1


def test_small_cells_share_a_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(1200, 8)))]
    df = spark.createDataFrame(rows, "id long, at long, vec array<double>")
    assert pruned_join.join(df, df, 0.5).where("id IS NULL").count() == 1


def test_events_and_their_entities_are_gathered_without_a_join(spark):
    ends = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (4, 7)], "event_id long, entity_id long")
    items = spark.createDataFrame([(1, "a", T0), (1, None, T0), (1, None, T0), (2, "a", T0), (3, "b", T0)], "event_id long, source_name string, published_at timestamp")
    names = spark.createDataFrame([(7,), (8,), (9,)], "entity_id long")
    edges = spark.createDataFrame([(7, 8, T0)], "src long, dst long, ts timestamp")
    out = cv.convergence_of_events(names, ends, items, edges)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # statistics and degrees meet the entities
    found = {r.entity_id: (r.distinct_sources, r.mentions, r.event_count, r.source_names) for r in out.collect()}
    assert found == {7: (1, 4, 2, ["a"]), 8: (1, 3, 1, ["a"]), 9: (0, 0, 0, [])}


def test_vectors_are_not_copied_for_each_block_they_meet(spark, monkeypatch):
    """However many blocks there are, each row is shuffled once a side; of pairs, few are multiplied in double precision."""
    for name, size in {"BLOCK": 16, "LEFT": 16, "SMALL": 16}.items():
        monkeypatch.setattr(pruned_join, name, size)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((5, 24))[rng.integers(5, size=200)] + 0.4 * rng.standard_normal((200, 24))
    v[150:] = v[:50]
    rows = [(i, i % 7, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, at long, vec array<double>")
    found = pruned_join.join(df, df, 0.5)
    plan = _plan(found)
    assert "Generate" not in plan and "CoGroup" not in plan and plan.count("Exchange") <= 1
    told = pruned_join.work(df, 0.5).first()
    assert told.candidates < told.bounded / 4
    s = np.round(np.array([r[2] for r in rows]) @ np.array([r[2] for r in rows]).T, 9)
    key = lambda i: (rows[i][1], i)
    want = {i: min(((-s[i, j], *key(j)) for j in range(200) if key(j) < key(i) and s[i, j] >= 0.5), default=None) for i in range(200)}
    got = {r.id: (-r.similarity, rows[r.parent][1], r.parent) for r in pruned_join.best_earlier(df, 0.5).collect()}
    assert got == {i: w for i, w in want.items() if w}


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_parsed_once_however_many_fields_are_read(spark):
    answer = '{"scores": {"relevance": 1, "novelty": 1, "actionability": 1, "strategic_potential": 3, "hype": 1}, "summary": "s"}'
    items = spark.createDataFrame([(i, "python and rag", "x", "rss") for i in range(4)], "event_id long, title string, summary string, source_type string")
    texts = spark.createDataFrame([(0, answer), (0, "no"), (1, f"Well: {answer} bye"), (2, "{"), (3, None)], "event_id long, text string")
    out = enrich.enriched(items, texts, texts)
    assert sorted((r.event_id, r.method, r.summary, r.relevance) for r in out.collect()) == [(0, "llm", "s", 1), (1, "llm", "s", 1), (2, "fallback", "x", 2), (3, "fallback", "x", 2)]
    plan = _parses(out)
    assert plan.count("_first_object") <= 2 and plan.count("parse_json") + plan.count("ParseJson") <= 8 and plan.count("lower(concat") == 1
