"""Small hand-made inputs and brute-force comparisons."""

import datetime as dt
import decimal
import hashlib
import itertools
import json
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorwise.functions import parse
from factorwise.functions.text import header_key, name_ratio
from factorwise.operators import cases, dedup, evaluation, features, graph, matching, models, retrieval, sampling, scoring, similarity
from factorwise.plans.ordered import exact_quantiles, number_rows, running_totals, with_halo
from factorwise.sources import files, normalise, tables

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# ------------------------------------------------------------ ordered helpers


def test_number_rows_and_halo_equal_a_plain_window(spark):
    data = [(k, i // 7, i, random.Random(i).random()) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(data, "g string, part int, i int, x double")
    numbered = number_rows(df, group=["g"], split=["part"], order=["i"])
    assert rows(numbered, "g", "i", "position") == sorted((k, i, i + 1) for k in "ab" for i in range(200))
    from pyspark.sql import Window as W

    blocks = with_halo(numbered, position="position", before=3, width=16)
    w = W.partitionBy("g", "_slice").orderBy("position").rowsBetween(-3, 0)
    got = rows(blocks.withColumn("s", F.sum("i").over(w)).where("_own"), "g", "i", "s")
    assert got == sorted((k, i, sum(range(max(0, i - 3), i + 1))) for k in "ab" for i in range(200))


def test_running_totals_and_quantiles(spark):
    values = [random.Random(i).lognormvariate(0, 3) for i in range(500)] + [7.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    q = exact_quantiles(df, value="v", probs=[0.0, 0.5, 0.9, 0.99, 1.0]).first()
    for i, p in enumerate([0, 50, 90, 99, 100]):
        assert math.isclose(q[f"q{i}"], float(np.percentile(values, p)), rel_tol=1e-9)
    counted = df.groupBy("v").agg(F.count("*").alias("n"))
    for descending in (False, True):
        got = {r["v"]: r["n_upto"] for r in running_totals(counted, value="v", measures=["n"], descending=descending).collect()}
        assert all(n == sum((x >= v) if descending else (x <= v) for x in values) for v, n in got.items())


# ------------------------------------------------------------------ ingestion


def test_amounts(spark):
    df = spark.createDataFrame([("0.125",), ("1.005",), ("2.675",), ("INR 1,234.50",), ("-5",), ("",), ("n/a",), ("1.2.3",)], "t string")
    got = [r[0] for r in df.select(parse.amount(F.col("t"))).collect()]
    want = ["0.12", "1.00", "2.68", "1234.50", "-5.00", "0.00", None, None]
    assert got == [None if w is None else decimal.Decimal(w) for w in want]


def test_dates_do_not_depend_on_the_shapes_of_layouts(spark, monkeypatch):
    """A layout tried on texts of its shape only finds the dates it finds on all texts."""
    days, months, years = ("1", "31", "0031", "2024", "-2024", "99"), ("2", "13", "003", "Feb", "FEB", "feb"), ("2", "24", "024", "2024", "0024", "+12024", "2024x")
    rows = [(f"{a}{sep}{b}{sep}{c}",) for sep in "-/ " for a in days for b in months for c in years]
    texts = spark.createDataFrame([*rows, (None,), ("",), ("n/a",)], "t string")
    found = lambda: sorted(texts.select("t", parse.date(F.col("t")).cast("string").alias("d")).collect(), key=str)
    shaped = found()
    assert set(parse._SHAPES) == set(parse.DATE_FORMATS) and sum(r.d is not None for r in shaped) > 20
    monkeypatch.setattr(parse, "_SHAPES", {})
    assert found() == shaped


def test_dates(spark):
    texts = {
        "2024-03-05": D(2024, 3, 5), "05/03/2024": D(2024, 3, 5), "03/25/2024": D(2024, 3, 25), "05-03-2024": D(2024, 3, 5),
        "03-25-2024": D(2024, 3, 25), "5/3/24": D(2024, 3, 5), "3/25/98": D(1998, 3, 25), "05-mar-2024": D(2024, 3, 5),
        "5 MAR 2024": D(2024, 3, 5), "31/31/2000": None, "": None, "1/1/69": D(1969, 1, 1), "1/1/68": D(2068, 1, 1),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: (r["d"], r["bad"]) for r in df.select("t", parse.date(F.col("t")).alias("d"), parse.date_failed(F.col("t")).alias("bad")).collect()}
    assert {t: v[0] for t, v in got.items()} == texts
    assert got["31/31/2000"][1] and not got[""][1]


def test_line_items(spark):
    texts = ['[{"description":"a","quantity":2}]', '{"description":"b"}', "plain", "", None, "[]", "3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(x["description"], x["quantity"]) for x in r[0]] for r in df.select(parse.line_items(F.col("t"))).collect()]
    assert got == [[("a", 2.0)], [("b", None)], [("plain", None)], [], [], [], []]


def test_headers_and_alias_order(spark):
    assert header_key("  Invoice  No.# ") == "invoice_no"
    df = spark.createDataFrame([(" ", "second", "x")], ["Invoice Number", "Invoice No", "Vendor"])
    out = normalise.resolve_aliases(normalise.normalise_headers(df)).first()
    assert out["invoice_number"] == "second" and out["supplier_name"] == "x" and out["po_number"] is None


def test_accepted_plus_rejected_is_everything(spark):
    data = [("f", "I1", "S", "B", "10", "2024-01-01"), ("f", "", "S", "B", "0", "x"), ("g", "I3", "S", "B", "7", "2024-01-02"), (None,) * 6]
    raw = spark.createDataFrame(data, "source_file string, invoice string, vendor string, customer string, sales string, date string")
    typed = normalise.normalise(raw, keep=["source_file"])
    bad = [r["reasons"] for r in typed.where(F.size("reasons") > 0).collect()]
    assert bad == [["invoice_number", "amount", "invoice_date"]]
    ok, rejected = normalise.validate_invoices(typed.drop("reasons"), fail_fast=True)
    assert rows(ok, "invoice_number") == [("I3",)] and rejected.count() == 1


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("﻿Invoice No,Vendor\n1,x\n,\n2,\"y, z\"\n", encoding="utf-8")
    (tmp_path / "in" / "b.json").write_text('[{"Invoice No": "3", "Vendor": "w"}]')
    (tmp_path / "in" / "some_note.txt").write_text("  two\nlines ")
    (tmp_path / "in" / "empty.md").write_text("  ")
    csv = files.ingest_csv(spark, str(tmp_path / "in" / "a.csv"))
    assert rows(normalise.drop_blank_rows(csv, columns=["Invoice No", "Vendor"]), "Invoice No", "Vendor") == [("1", "x"), ("2", "y, z")]
    schema = spark.createDataFrame([], "`Invoice No` string, Vendor string").schema
    mixed = files.ingest_dispatch(spark, str(tmp_path / "in"), schema)
    assert {r["source_format"] for r in mixed.collect()} == {"csv", "json", "text"}
    docs = files.ingest_text_dir(spark, str(tmp_path / "in"))
    assert rows(docs, "id", "title", "content", "category") == [("some_note", "Some Note", "two\nlines", "regulation")]


def test_merge_by_key_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = tables.merge_by_key(old, new, key="k")
    assert rows(once) == rows(tables.merge_by_key(once, new, key="k")) == [(1, "a"), (2, "B"), (3, "c")]


# ----------------------------------------------------------------- duplicates

INV = "invoice_id string, invoice_number string, supplier_name string, buyer_name string, amount decimal(18,2), invoice_date date, po_number string"


def test_fingerprint_matches_the_canonical_text(spark):
    one = spark.createDataFrame([("x", "INV-1", " ACME\tLtd ", "Büyer", decimal.Decimal("5.5"), D(2024, 1, 2), None)], INV)
    text = json.dumps(
        {"amount": "5.50", "buyer_name": "büyer", "invoice_date": "2024-01-02", "invoice_number": "inv-1", "po_number": "", "supplier_name": "acme\tltd"},
        sort_keys=True, separators=(",", ":"), ensure_ascii=False,
    )
    assert dedup.sha_fingerprint(one).first()["sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_later_copy_is_the_duplicate(spark):
    row = ("N", "S", "B", decimal.Decimal("1.00"))
    df = spark.createDataFrame([("b", *row, D(2024, 1, 1), "P"), ("a", *(" n ", "s", "b ", row[3]), D(2024, 1, 1), "p"), ("c", *row, D(2024, 1, 2), "P")], INV)
    got = {r["invoice_id"]: (r["is_exact_duplicate"], r["first_invoice_id"]) for r in dedup.exact_duplicates(df).collect()}
    assert got == {"a": (False, "a"), "b": (True, "a"), "c": (False, "c")}
    registry = dedup.register_fingerprints(df.withColumns({c: F.lit(1).cast("long") for c in ("supplier_id", "buyer_id", "lender_id")}))
    assert not any(r["is_exact_duplicate"] for r in dedup.exact_duplicates(df.where("invoice_id = 'a'"), registry=registry).collect())
    assert dedup.exact_duplicates(df.where("invoice_id = 'b'"), registry=registry).first()["is_exact_duplicate"]


def token_frame(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 14))] for _ in range(120)]
    near = [b[:-1] + ["z"] for b in base[:60]]
    hot = [["common", "text", "of", "a", "third"]] * 90  # one group of copies
    data = [(f"d{i:03d}", sorted(set(t))) for i, t in enumerate(base + near + hot)]
    return data, spark.createDataFrame(data, "invoice_id string, tokens array<string>")


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_jaccard_pairs_equal_brute_force(spark, threshold):
    data, df = token_frame(spark)
    sets, members = similarity.token_sets(df)
    distinct = {tuple(t) for _, t in data}
    want = sorted(round(len(set(a) & set(b)) / len(set(a) | set(b)), 9) for a, b in itertools.combinations(distinct, 2)
                  if len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold)
    pairs = similarity.jaccard_pairs(sets, threshold=threshold)
    assert sorted(round(r["jaccard"], 9) for r in pairs.collect()) == want
    counts = {r["invoice_id"]: r["candidate_count"] for r in similarity.candidate_counts(pairs, members).collect()}
    whole = {i: sum(1 for j, u in data if j != i and len(set(t) & set(u)) / len(set(t) | set(u)) >= threshold) for i, t in data}
    assert counts == whole


@pytest.mark.parametrize("hot_bucket", [2000, 1])
def test_lsh_pairs_are_exact_pairs(spark, hot_bucket):
    _, df = token_frame(spark)
    sets, _ = similarity.token_sets(df)
    exact = set(rows(similarity.jaccard_pairs(sets), "set_a", "set_b"))
    found = set(rows(similarity.lsh_candidates(sets, hot_bucket=hot_bucket), "set_a", "set_b"))
    assert found <= exact and len(found) >= 0.97 * len(exact)


@pytest.mark.parametrize("limit", [None, 1.0])
def test_nearest_equals_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (80, 6)) for c in (0, 2, 4)])
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    got = similarity.nearest(df.withColumnRenamed("id", "query_id"), df, k=4, max_distance=limit)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = [(f"v{q:03d}", f"v{b:03d}") for q in range(len(x)) for b in np.argsort(d[q], kind="stable")[:4] if limit is None or d[q, b] <= limit]
    assert rows(got, "query_id", "id") == sorted(want)


# ------------------------------------------------------------------- matching


def test_name_ratio_equals_sequence_matcher(spark):
    names = ["Acme Traders Ltd", "ACME  traders", "Traders Acme", "Zenith", "", "acme trader limited"]
    df = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    for r in df.select("a", "b", name_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        a, b = (" ".join(x.lower().split()) for x in (r["a"], r["b"]))
        assert math.isclose(r["r"], SequenceMatcher(None, a, b).ratio() if a and b else 0.0, abs_tol=1e-12)


def test_three_way_match_and_phantom(spark):
    inv = spark.createDataFrame(
        [("ok", "po-1", "g-1", "Acme", "Buyer", 100.0, D(2024, 1, 5), 10.0), ("phantom", None, None, "Acme", "Buyer", 100.0, D(2024, 1, 5), 10.0),
         ("wrong", "po-2", None, "Acme", "Buyer", 100.0, D(2024, 1, 5), None)],
        "invoice_id string, po_number string, grn_number string, supplier_name string, buyer_name string, amount double, invoice_date date, quantity double",
    ).withColumn("currency", F.lit("INR"))
    po = spark.createDataFrame([("PO-1", 101.0, 10.0, "ACME", "Buyer"), ("PO-2", 500.0, 3.0, "Other Co", "Nobody")],
                               "po_number string, amount double, quantity double, supplier_name string, buyer_name string")
    grn = spark.createDataFrame([("G-1", D(2024, 1, 3), 10.0, "Acme", "Buyer")], "grn_number string, delivery_date date, quantity double, supplier_name string, buyer_name string")
    out = matching.three_way_match(inv, po, grn)
    got = {r["invoice_id"]: r for r in out.collect()}
    assert got["ok"]["passed"] and got["ok"]["overall"] == 1.0 and got["ok"]["anomalies"] == []
    assert got["phantom"]["overall"] == 0.0 and got["phantom"]["anomalies"] == [matching.NO_PO, matching.NO_GRN]
    assert got["wrong"]["anomalies"] == [matching.NO_GRN, "PO_AMOUNT_MISMATCH", "PO_SUPPLIER_MISMATCH", "PO_BUYER_MISMATCH"]
    assert got["wrong"]["po_score"] == 0.4
    assert rows(matching.phantom_flag(out), "invoice_id") == [("phantom",), ("wrong",)]


# ---------------------------------------------------------------------- graph


def test_rings(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (4, 1), (5, 5)], "src bigint, dst bigint")
    assert sorted(r["members"] for r in graph.carousel_rings(e).collect()) == [[1, 2], [1, 2, 3]]


def test_rings_equal_brute_force(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(26)}
    want = set()
    for n in range(2, 7):
        for p in itertools.permutations(range(9), n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                want.add(p)
    e = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    got = [tuple(r["members"]) for r in graph.carousel_rings(e).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cascade_window(spark):
    day0 = D(2024, 1, 10)  # a Wednesday
    e = spark.createDataFrame([(D(2024, 1, 8), 1, 2)], "week date, src bigint, dst bigint")
    data = [("root", 1, 0)] + [(f"d{o}", 2, o) for o in (-2, -1, 0, 3, 4)]
    inv = spark.createDataFrame([(i, c, day0 + dt.timedelta(days=o), decimal.Decimal("10.00")) for i, c, o in data], "invoice_id string, company bigint, invoice_date date, amount decimal(18,2)")
    inv = inv.withColumn("week", F.date_trunc("week", "invoice_date").cast("date"))
    got = {r["invoice_id"]: (r["cascade_depth"], r["exposure"]) for r in graph.cascade_trace(inv, inv, e).collect()}
    assert got["root"] == (3, 30.0) and got["d0"] == (0, 0.0)


def test_upsert_keeps_known_risk(spark):
    nodes = spark.createDataFrame([("a", "supplier", 0.8)], "id string, node_type string, risk_score double")
    fresh = spark.createDataFrame([("a", "supplier", 0.0), ("b", "buyer", 0.0)], "id string, node_type string, risk_score double")
    edge = spark.createDataFrame([("a", "b", "SUPPLIES_TO", 1, 5.0, D(2024, 1, 1))], "src string, dst string, rel_type string, invoice_count long, amount double, since date")
    n, e = graph.graph_upsert(nodes, edge, fresh, edge)
    assert rows(n, "id", "risk_score") == [("a", 0.8), ("b", 0.0)] and e.first()["invoice_count"] == 2


# --------------------------------------------------------- features and scores


def test_velocity_counts_only_the_window(spark):
    day = D(2024, 5, 10)
    dates = [day] * 10 + [day - dt.timedelta(days=8), day + dt.timedelta(days=1)]
    inv = spark.createDataFrame([("s", d, decimal.Decimal("1.00")) for d in dates], "supplier_id string, invoice_date date, amount decimal(18,2)")
    assert rows(features.supplier_velocity(inv, asof=day)) == [("s", 10, 11, 10.0)]
    assert (("s", day, 10, 11, 10.0)) in rows(features.velocity_points(inv))


def test_decision_and_severity_cuts(spark):
    df = spark.createDataFrame([(str(x), x) for x in (0.6999, 0.70, 0.8499, 0.85, 0.9)], "invoice_id string, value double")
    assert [r["value"] for r in scoring.fraud_decision(df).collect()] == ["PASS", "REVIEW", "REVIEW", "HOLD", "HOLD"]
    assert [r["value"] for r in scoring.severity(df).collect()] == ["medium", "medium", "high", "high", "critical"]


def test_match_score_zero_is_not_a_match(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, False), ("b", 0.0, None, False)], "invoice_id string, duplicate_risk_score double, match_score double, is_exact_duplicate boolean")
    assert rows(scoring.heuristic_score(df)) == [("a", 0.3), ("b", 0.0)]


def test_contributions_add_up(spark):
    rng = random.Random(2)
    names = list(scoring.ENSEMBLE_WEIGHTS)
    df = spark.createDataFrame([(str(i), *[rng.random() / 2 for _ in names]) for i in range(40)], ["invoice_id", *names])
    total = scoring.contributions(df).groupBy("invoice_id").agg(F.sum("contribution").alias("c"))
    score = scoring.ensemble_score(df).collect()
    mean = sum(r["value"] for r in score) / len(score)
    by_id = {r["invoice_id"]: r["c"] for r in total.collect()}
    assert all(abs(by_id[r["invoice_id"]] - (r["value"] - mean)) < 1e-6 for r in score)


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    cut = lambda d: sampling.stratified_split(d, key="k", fractions={"train": 0.7, "val": 0.15, "test": 0.15})
    counts = {(r["label"], r["split"]): r["count"] for r in cut(df).groupBy("label", "split").count().collect()}
    assert counts[(0, "train")] == 630 and counts[(0, "val")] == 135 and counts[(1, "train")] == 70 and counts[(1, "test")] == 15
    assert rows(cut(df), "k", "split") == rows(cut(df.repartition(5)), "k", "split")


def test_oversampling_reaches_the_ratio(spark):
    rng = np.random.default_rng(1)
    data = [(str(i), *map(float, rng.normal(0, 1, 2)), 0) for i in range(300)] + [(f"p{i}", *map(float, rng.normal(1.2, 1, 2)), 1) for i in range(40)]
    df = spark.createDataFrame(data, "k string, a double, b double, label int")
    out = sampling.minority_oversample(df, key="k", features=["a", "b"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {0: 300, 1: 90}


def test_masks_hide_about_the_given_share(spark):
    seqs = spark.range(400).select(F.lit("s").alias("supplier_id"), F.col("id").cast("string").alias("end_id"), F.array_repeat(F.array(F.lit(1.0)), 8).alias("seq"), F.lit(0).alias("label"))
    masked = features.mask_sequences(seqs).select(F.avg(F.size(F.filter("mask", lambda m: m)) / 8.0)).first()[0]
    assert 0.12 < masked < 0.18


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(0)
    data = [(f"n{i}", rng.normal(0, 1, 3).tolist()) for i in range(500)] + [("far", [9.0, -9.0, 9.0])]
    df = spark.createDataFrame(data, "id string, vector array<double>")
    scores = models.isolation_forest(df.where("id <> 'far'"), df, trees=50, sample=128)
    assert scores.orderBy(F.desc("anomaly_prob")).first()["id"] == "far"


# ----------------------------------------------------------------- evaluation


def test_metrics_with_ties(spark):
    rng = random.Random(4)
    data = [(i, rng.randrange(20) / 20, int(rng.random() < 0.3)) for i in range(300)]
    sl = spark.createDataFrame(data, "id int, score double, label int")
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluation.auc_roc(sl).first()[0] - auc) < 1e-6
    for r in evaluation.threshold_sweep(sl).collect():
        t = r["threshold"]
        assert (r["tp"], r["fp"]) == (sum(s >= t for s in pos), sum(s >= t for s in neg))


# -------------------------------------------------------- cases and retrieval


def test_upsert_keeps_the_analyst(spark):
    base = spark.createDataFrame([("a", 0.9, ["x"], D(2024, 1, 1), "HOLD"), ("b", 0.4, [], D(2024, 1, 2), "REVIEW")],
                                 "invoice_id string, fraud_score double, fraud_patterns array<string>, invoice_date date, fraud_decision string")
    base = base.withColumns({"invoice_number": F.col("invoice_id"), "amount": F.lit(1.0), "lender_id": F.lit("L")})
    opened = cases.open_cases(base)
    assert rows(opened, "case_number", "primary_signal") == [("SCF-2024-000001", "x"), ("SCF-2024-000002", "UNKNOWN")]
    done = opened.withColumns({"analyst_decision": F.lit("cleared"), "analyst_notes": F.lit("ok")})
    again = cases.upsert_cases(done, opened)
    assert rows(again, "invoice_id", "analyst_decision") == [("a", "cleared"), ("b", "cleared")]
    assert cases.audit_log(done, again).count() == 0
    assert rows(cases.audit_log(opened.where("invoice_id = 'a'"), again), "event_type", "invoice_id") == [
        ("analyst_decision_updated", "a"), ("analyst_decision_updated", "b"), ("fraud_case_created", "b")]


def test_chunks_cover_the_text():
    text = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(60)) for i in range(9)) + "y" * 1500
    chunks = retrieval.split_text(text)
    assert all(0 < len(c) <= 512 for c in chunks)
    assert all(w in " ".join(chunks) for w in text[:-1500].split())
    assert sum(c.count("y") for c in chunks) >= 1500
    assert retrieval.split_text("short") == ["short"]


# ------------------------------------------------------- runs, rare classes, outliers


def test_case_numbers_of_two_runs_differ(spark):
    def scored(ids):
        df = spark.createDataFrame([(i, 0.9, ["x"], D(2024, 3, 1), "HOLD") for i in ids], "invoice_id string, fraud_score double, fraud_patterns array<string>, invoice_date date, fraud_decision string")
        return df.withColumns({"invoice_number": F.lit("inv-1"), "amount": F.lit(1.0), "lender_id": F.lit("L")})

    first = cases.open_cases(scored("ab"))
    both = cases.upsert_cases(first, cases.open_cases(scored("bcd")))
    numbers = {r.invoice_id: r.case_number for r in both.collect()}
    assert len(set(numbers.values())) == 4 and {numbers["a"], numbers["b"]} == {"SCF-2024-000001", "SCF-2024-000002"}
    assert sorted(r.case_number for r in cases.open_cases(scored("z"), stored=both).collect()) == ["SCF-2024-000005"]
    stored = spark.createDataFrame([("inv-1", "CASE-INV-1"), ("inv-1", "CASE-INV-1-2")], "invoice_number string, case_number string")
    assert [r.case_number for r in cases.dedupe_case_numbers(scored("q"), stored=stored).collect()] == ["CASE-INV-1-3"]


def test_two_updates_of_a_case(spark):
    base = cases.open_cases(
        spark.createDataFrame([("a", 0.9, ["x"], D(2024, 1, 1), "HOLD")], "invoice_id string, fraud_score double, fraud_patterns array<string>, invoice_date date, fraud_decision string")
        .withColumns({"invoice_number": F.col("invoice_id"), "amount": F.lit(1.0), "lender_id": F.lit("L")})
    )
    case_id = base.first().case_id
    updates = spark.createDataFrame([(case_id, "confirmed", "n1", 1), (case_id, "cleared", "n2", 2), ("?", "x", None, 1)], "case_id string, decision string, notes string, at int")
    done, unknown = cases.analyst_updates(base, updates, at="at")
    assert rows(done, "analyst_decision", "analyst_notes") == [("cleared", "n2")] and rows(unknown, "case_id") == [("?",)]


def test_two_orders_of_one_number(spark):
    inv = spark.createDataFrame([("i1", "PO-1", None)], "invoice_id string, po_number string, grn_number string")
    po = spark.createDataFrame([("PO-1", 5.0), (" po-1 ", 9.0)], "po_number string, amount double")
    grn = spark.createDataFrame([("G", 1.0)], "grn_number string, quantity double")
    got = matching.match_documents(inv, po, grn).collect()
    assert len(got) == 1 and got[0].has_po and not got[0].has_grn


def test_rings_of_text_ids(spark):
    edges = spark.createDataFrame([("S-1", "S-2"), ("S-2", "S-3"), ("S-3", "S-1"), ("S-2", "S-1")], "src string, dst string")
    assert sorted(r.members for r in graph.carousel_rings(edges).collect()) == [["S-1", "S-2"], ["S-1", "S-2", "S-3"]]


@pytest.mark.parametrize("positives", [100, 10])
def test_resample_balances_rare_classes(spark, positives):
    df = spark.range(100_000).select("id", (F.col("id") < positives).cast("int").alias("label"))
    got = dict(rows(sampling.weighted_resample(df, key="id").groupBy("label").count(), "label", "count"))
    assert abs(got[1] / (got[0] + got[1]) - 0.5) < 0.01 and abs(got[0] + got[1] - 100_000) < 1000


def test_outlier_does_not_fill_a_bucket(spark):
    counted = spark.range(100_000).select(F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") / 7).alias("v"), F.lit(1).alias("n"))
    upto = running_totals(counted, value="v", measures=["n"])
    got = upto.where("v > 1e8 or v < 1").orderBy("v").collect()
    assert [r.n_upto for r in got] == [1, 2, 3, 4, 5, 6, 100_000]
    cuts = counted.agg(F.percentile_approx("v", [i / 1024 for i in range(1, 1024)], 20 * 1024)).first()[0]
    assert max(np.bincount(np.searchsorted(cuts, [r.v for r in counted.collect()], side="right"))) <= 1000


def test_cascade_counts_all(spark):
    e = spark.createDataFrame([(D(2024, 1, 8), i, i + 1) for i in range(1, 6)] + [(D(2024, 1, 8), 6, 1)], "week date, src bigint, dst bigint")
    data = [("root", 1, 0)] + [(f"x{i:02d}", 6, i % 3) for i in range(45)]
    inv = spark.createDataFrame([(i, c, D(2024, 1, 10) + dt.timedelta(days=o), decimal.Decimal("10.00")) for i, c, o in data], "invoice_id string, company bigint, invoice_date date, amount decimal(18,2)")
    inv = inv.withColumn("week", F.date_trunc("week", "invoice_date").cast("date"))
    got = {r["invoice_id"]: (r["cascade_depth"], r["exposure"]) for r in graph.cascade_trace(inv, inv, e).collect()}
    assert got["root"] == (45, 450.0) and got["x00"] == (45, 450.0)  # the ring leads back to both companies
    late = inv.withColumn("invoice_date", F.when(F.col("invoice_id") == "root", F.col("invoice_date")).otherwise(F.date_add("invoice_date", 14)))
    got = {r["invoice_id"]: r["cascade_depth"] for r in graph.cascade_trace(inv.where("invoice_id = 'root'"), late, e, hours=480).collect()}
    assert got["root"] == 45


def test_resample_is_multinomial(spark):
    """Copies of a class's rows vary as draws with replacement do, in both classes; totals are exact."""
    n, positives = 40_000, 4_000
    df = spark.range(n).select("id", (F.col("id") < positives).cast("int").alias("label"))
    got = sampling.weighted_resample(df, key="id").groupBy("label", "id").count().collect()
    for label, size in ((1, positives), (0, n - positives)):
        counts = np.array([r["count"] for r in got if r.label == label])
        assert counts.sum() == n // 2
        mean = n / 2 / size
        whole = np.concatenate((counts, np.zeros(size - len(counts))))
        assert abs(whole.var() / (mean * (1 - 1 / size)) - 1) < 0.1  # binomial variance
        assert abs((whole == 0).mean() - math.exp(-mean)) < 0.01
    again = sampling.weighted_resample(df.repartition(3), key="id").groupBy("label", "id").count().collect()
    assert set(again) == set(got)
    one = sampling.weighted_resample(df.where("id >= 39000 or id = 0"), key="id").groupBy("id").count().where("id = 0").first()
    assert one["count"] == 500
    assert sampling.weighted_resample(df.where("label = 0").limit(50), key="id").count() == 50
    assert sampling.weighted_resample(df.limit(0), key="id").count() == 0


def test_codes_of_prefixed_texts(spark):
    df = spark.range(30_000).select(
        F.format_string("Customer#%09d", (F.col("id") * 7919) % 20_011).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b")
    )
    codes = features.code_dictionary(df, ["a", "b"], slices=200)
    sizes = codes.groupBy("slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 0.012 * 20_011
    got = features.label_encode(df, ["a", "b"]).collect()
    want = {c: {x: i for i, x in enumerate(sorted({str(r[c]) if r[c] is not None else "UNKNOWN" for r in got}))} for c in "ab"}
    assert len(got) == 30_000 and all(r[f"{c}_enc"] == want[c][str(r[c]) if r[c] is not None else "UNKNOWN"] for r in got for c in "ab")


def test_ego_network_serves_every_company_of_every_week(spark):
    """The query has a centre for each company that trades in a week, not for ring members alone."""
    from factorwise.plans import views
    from factorwise.plans.catalog import load

    sf = "/root/testdata/sf0.001"
    edges = views.trade_edges(spark, sf)
    want = edges.selectExpr("week", "explode(array(src, dst)) as center_id").distinct()
    got = load().queries["ego_network"](spark, sf).select("week", "center_id").distinct()
    assert got.count() == want.count() == got.join(want, ["week", "center_id"]).count()


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_ego_network_takes_the_fewest_hops(spark, depth):
    edges = spark.createDataFrame([("w", 1, 2), ("w", 2, 3), ("w", 3, 4), ("w", 4, 1), ("w", 4, 5), ("v", 5, 6)], "week string, src long, dst long")
    got = {(r.week, r.center_id, r.node_id): r.hop for r in graph.ego_network(edges, depth=depth, slices=["week"]).collect()}
    near = {"w": {1: {2, 4}, 2: {1, 3}, 3: {2, 4}, 4: {1, 3, 5}, 5: {4}}, "v": {5: {6}, 6: {5}}}
    want = {}
    for week, links in near.items():
        for start in links:
            level = {start}
            for hop in range(depth + 1):
                for node in level:
                    want.setdefault((week, start, node), hop)
                level = {n for m in level for n in links[m]}
    assert got == want


def test_candidates_stay_few_when_rare_tokens_share_buckets_with_frequent_ones(spark, monkeypatch):
    """Sets of one order share its number and little else: they are no candidates, whatever buckets their tokens fall into."""
    monkeypatch.setattr(similarity, "FREQUENCY_BUCKETS", 64)
    sizes = []
    keep = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: sizes.append((df.columns, out := keep(df))) or out)
    rng = random.Random(8)
    common = ["supplier", "customer"]
    data = [sorted({f"po-{i}", f"inv-{i // 4}", *common, *(f"{c}{rng.randrange(40)}" for c in "abcdef")}) for i in range(600)]
    data.append(sorted({*data[7][:-1], "zz"}))
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(data)], "invoice_id string, tokens array<string>")
    found = similarity.jaccard_pairs(similarity.token_sets(df)[0])
    want = sum(len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b)) for a, b in itertools.combinations(data, 2))
    assert found.count() == want >= 1
    candidates = next(df for columns, df in sizes if columns == ["k_a", "k_b"])
    assert candidates.count() <= 2 * want + 20


def test_quantiles_between_bounds_are_exact(spark):
    """Above ACCURACY rows only values between the bounds are counted, ties and several probabilities included."""
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=40_000), "b": np.repeat([1.0, 2.0, 7.0], [15_000, 9_000, 6_000]), "c": rng.integers(0, 9, 30).astype(float)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    for r in exact_quantiles(df, value="v", probs=probs, group=["g"]).collect():
        assert [r[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(data[r["g"]], probs), abs=1e-9)
        assert r["n"] == len(data[r["g"]])
    one = exact_quantiles(df.where("g = 'a'"), value="v", probs=probs).first()
    assert [one[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(data["a"], probs), abs=1e-9)


def test_split_numbers_only_the_slices_with_a_cut(spark):
    """Repeated keys at a cut included, each class is cut as the numbering of all its rows would."""
    df = spark.createDataFrame([(f"k{i // 3}", int(i % 7 == 0), i) for i in range(20_000)] + [(None, 1, 1), ("x", None, 1)], "k string, label int, i int")
    cut = sampling.stratified_split(df, key="k", fractions={"train": 0.7, "val": 0.15, "test": 0.15})
    assert cut.columns == ["label", "k", "i", "split"]
    got = {(r["label"], r["split"]): r["count"] for r in cut.groupBy("label", "split").count().collect()}
    order = sampling._numbered(df, "k", "label", 42).select("label", "k", "i", "position")
    n = {r["label"]: r["count"] for r in df.where("k is not null and label is not null").groupBy("label").count().collect()}
    assert got == {(y, s): v for y in n for s, v in zip(("train", "val", "test"), (int(n[y] * 0.7 + 1e-9), int(n[y] * 0.85 + 1e-9) - int(n[y] * 0.7 + 1e-9), n[y] - int(n[y] * 0.85 + 1e-9)))}
    edge = cut.join(order, ["label", "k", "i"]).groupBy("label", "split").agg(F.min("position").alias("a"), F.max("position").alias("z")).collect()
    bounds = {(r["label"], r["split"]): (r["a"], r["z"]) for r in edge}
    for y in n:  # up to rows of one key, which are interchangeable
        assert bounds[y, "train"][1] <= bounds[y, "val"][0] + 5 and bounds[y, "val"][1] <= bounds[y, "test"][0] + 5
    plan = cut.where("split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 1


def test_invoices_of_unknown_parts_have_a_duplicate_risk(spark, tmp_path):
    from pathlib import Path

    from factorwise.plans import views
    from factorwise.plans.catalog import load

    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if file.name != "part.parquet":
            (tmp_path / file.name).symlink_to(file)
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey % 5 <> 0").write.parquet(str(tmp_path / "part.parquet"))
    risk = load().queries["duplicate_risk"](spark, str(tmp_path))
    assert risk.count() == views.invoices(spark, str(tmp_path)).count()


def test_only_keys_that_come_again_are_moved(spark, monkeypatch):
    """Rows whose set or fingerprint is their own stay where they are; the results are those of grouping all rows."""
    from factorwise.plans import ordered

    def text(df):
        return sorted(str(tuple(r)) for r in df.collect())

    kept = []
    keep = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: kept.append(out := keep(df)) or out)
    data = [(f"i{n}", [f"w{n}", "x"]) for n in range(200)] + [(f"c{n}", ["same", "x"]) for n in range(5)] + [("e", []), ("n", None), (None, ["w0", "x"])]
    tokens = spark.createDataFrame(data, "invoice_id string, tokens array<string>")
    sets, members = similarity.token_sets(tokens)
    assert kept[0].count() <= 20
    plain = members.groupBy("set_id").agg(F.count("*").alias("members"), F.min("invoice_id").alias("first_id"))
    assert text(sets.select("set_id", "members", "first_id")) == text(plain)
    pairs = similarity.jaccard_pairs(sets, threshold=0.3)
    counts = [text(similarity.candidate_counts(pairs, members, sets=s)) for s in (sets, None)]
    assert counts[0] == counts[1] and len(counts[0]) == len(data) - 1
    prints = [(f"p{n}", D(2024, 1, 1 + n % 5), f"s{n // 3 if n < 30 else n}") for n in range(90)] + [(None, D(2024, 1, 1), "s7"), ("z", None, "s40"), ("q", D(2024, 1, 1), None)]
    df = spark.createDataFrame(prints, "invoice_id string, invoice_date date, sha256 string")
    first = df.groupBy("sha256").agg(F.min(F.struct("invoice_date", "invoice_id")).alias("f"))
    want = df.join(first, "sha256").select("invoice_id", "sha256", F.col("f.invoice_id") != F.col("invoice_id"), "f.invoice_id")
    for slots in (1 << 21, 4):  # with four slots nearly every row shares one with a repeated hash
        monkeypatch.setattr(ordered, "SLOTS", slots)
        assert text(dedup.exact_duplicates(df)) == text(want)


def test_match_in_parts_equals_the_planners(spark):
    """A task's share of a match is bounded by the parts, whatever the session's partitions; the rows stay the same."""
    inv = spark.createDataFrame([(f"i{n}", f" PO-{n % 150} " if n % 7 else None, f"grn-{n}" if n % 3 else None) for n in range(400)], "invoice_id string, po_number string, grn_number string")
    po = spark.createDataFrame([(f"po-{n}", float(n)) for n in range(0, 150, 2)] * 2, "po_number string, amount double")
    grn = spark.createDataFrame([(f"GRN-{n}", float(n)) for n in range(0, 400, 5)], "grn_number string, quantity double")
    cut = matching.match_documents(inv, po, grn, parts={"po": 23, "grn": 29})
    assert rows(cut.na.fill("")) == rows(matching.match_documents(inv, po, grn).na.fill("")) and cut.count() == 400
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 23), REPARTITION_BY_NUM") == 2 and plan.count(", 29), REPARTITION_BY_NUM") == 2


def test_a_status_of_each_kind_decides_the_receipt(spark, tmp_path):
    """Only when all known statuses are open there is none; the flag needs no sort of the lines."""
    from pathlib import Path

    from factorwise.plans import views

    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if file.name != "lineitem.parquet":
            (tmp_path / file.name).symlink_to(file)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    status = F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_orderkey") % 2 == 0, "O").otherwise(F.col("l_linestatus"))
    lines.withColumn("l_linestatus", status).write.parquet(str(tmp_path / "lineitem.parquet"))
    inv = views.invoices(spark, str(tmp_path), copies=False)
    known = spark.read.parquet(str(tmp_path / "lineitem.parquet")).groupBy(F.concat("l_orderkey", F.lit("-"), "l_suppkey").alias("invoice_id")).agg(F.collect_set("l_linestatus").alias("s"))
    wrong = inv.join(known, "invoice_id").where(F.col("grn_number").isNotNull() != (F.size(F.array_remove("s", "O")) > 0))
    assert wrong.count() == 0 and inv.where("grn_number is null").count() > 0
    assert "SortAggregate" not in inv._jdf.queryExecution().executedPlan().toString()


def test_a_written_result_leaves_no_shuffle_files(spark):
    """Disk is that of the stored tables and of one step's exchanges, not of all steps before."""
    import gc
    import time

    from factorwise.plans import materialise

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    gc.collect()
    before, setting = files(), spark.conf.get(materialise.FREE_SHUFFLES)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    kept = [materialise.written(df), materialise.stage_table(spark, "freed", "test", lambda: df)]
    until = time.time() + 10
    while files() - before and time.time() < until:  # removed in the background
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(materialise.FREE_SHUFFLES) == setting
    assert [k.agg(F.sum("s")).first()[0] for k in kept] == [499500, 499500]


def test_the_documents_of_an_order_share_one_grouping_of_its_lines(spark, tmp_path):
    """Invoices, purchase orders and receipts read the stored groups, not the lines again; sums are those of the lines."""
    from pathlib import Path

    from factorwise.plans import views

    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / file.name).symlink_to(file)
    sf = str(tmp_path)
    inv, po, grn = views.invoices(spark, sf, copies=False), views.purchase_orders(spark, sf), views.goods_receipts(spark, sf)
    for df in (inv, po, grn):
        assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    key = lambda p: F.concat(F.lit(p), F.col("l_orderkey"), F.lit("-"), F.col("l_suppkey")).alias("k")
    gross = lines.where("l_orderkey % 9 <> 0").groupBy(key("PO-")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)"))
    assert rows(po.select("po_number", "amount")) == rows(gross)
    got = lines.groupBy(key("GRN-")).agg(F.max("l_shipdate").cast("date"), F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(-1.0)))
    assert rows(grn.select("grn_number", "delivery_date", F.coalesce("quantity", F.lit(-1.0)))) == rows(got)


def test_the_lines_of_a_large_table_are_grouped_in_parts(spark, tmp_path, monkeypatch):
    """A task's share of the lines is that of a part, whatever the session's partitions; the groups stay the same."""
    from pathlib import Path

    from factorwise.plans import views

    plain = rows(views.goods_receipts(spark, "/root/testdata/sf0.001"))
    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / file.name).symlink_to(file)
    monkeypatch.setattr(views, "TASK_LINES", 300)
    n = views.line_parts(spark, str(tmp_path))
    assert n >= 15
    plan = views._order_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n}), REPARTITION_BY_NUM") == 2
    assert rows(views.goods_receipts(spark, str(tmp_path))) == plain


def test_a_phantom_is_told_from_one_verdict(spark):
    """The filter takes the verdict as it is; it does not hold the checks behind it."""
    import re

    inv = spark.createDataFrame(
        [("a", "po-1", None), ("b", "po-1", " "), ("c", "po-1", "grn-1"), ("d", None, None), ("e", "po-2", "")], "invoice_id string, po_number string, grn_number string"
    ).withColumns({"amount": F.lit(10.0), "quantity": F.lit(1.0), "supplier_name": F.lit("Acme"), "buyer_name": F.lit("Bolt"), "invoice_date": F.lit(D(2024, 1, 1)), "currency": F.lit("INR")})
    party = {"quantity": F.lit(1.0), "supplier_name": F.lit("Acme"), "buyer_name": F.lit("Bolt")}
    po = spark.createDataFrame([("po-1", 10.0)], "po_number string, amount double").withColumns(party)
    grn = spark.createDataFrame([("grn-1", D(2024, 1, 1))], "grn_number string, delivery_date date").withColumns(party)
    flags = matching.phantom_flag(matching.three_way_match(inv, po, grn))
    assert rows(flags, "invoice_id") == [("a",), ("b",), ("d",), ("e",)]
    assert re.search(r"Filter NOT passed#\d+\n", flags._jdf.queryExecution().optimizedPlan().toString())


def test_the_stream_and_the_scores_read_one_stored_match(spark, tmp_path):
    """Both orders of asking give the match with all its columns."""
    from pathlib import Path

    from factorwise.plans import views
    from factorwise.plans.catalog import load

    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / file.name).symlink_to(file)
    n = views.scored_invoices(spark, str(tmp_path)).count()
    assert load().queries["stream_score"](spark, str(tmp_path)).count() > 0
    assert views.stored_match(spark, str(tmp_path)).select("invoice_id", "overall", "passed").count() == n
