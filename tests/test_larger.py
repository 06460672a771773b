"""What only larger tables show: keys of seven digits, many kinds of groups, long sequences, wide groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievelight.plans.all_queries import ORACLE_SQL, QUERIES
from tools.verify import compare, connect


@pytest.fixture(scope="module")
def long_keys(spark, sf, tmp_path_factory):
    """The orders with keys around a million."""
    folder = tmp_path_factory.mktemp("long_keys")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") + 999_500).toPandas().to_parquet(f"{folder}/orders.parquet", coerce_timestamps="us", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ("q_run_records", "q_source_bank"))
def test_numbers_of_seven_digits(spark, long_keys, name):
    assert compare(spark, connect(long_keys), name, QUERIES[name], ORACLE_SQL[name], long_keys) == ""


def test_only_characters_that_can_change_are_told(spark):
    """The class with its short way for ASCII against the plain one."""
    from sievelight.functions import text as T

    c = F.col("c")
    rows = spark.createDataFrame([(chr(i),) for i in (*range(0x400), 0xFB01, 0xFFFF, 0x1F600)], "c string")
    assert rows.where(c.rlike(T.INERT) != c.rlike(f"[^{T._inert_class()}]")).count() == 0 and T.INERT.startswith(r"[\r\x{80}-")


def test_fingerprints_are_settled_before_they_are_tested(spark):
    """A long chain below a test for null would run again for every test."""
    from sievelight.functions import text as T
    from sievelight.operators import joins

    rows = T.with_views(spark.createDataFrame([("a", "x 1"), ("b", "x  1"), ("c", "y"), ("d", None)], "id string, question_raw string"))
    found = joins.duplicate_groups(rows, "source_fp")
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.n, r.first_id, r.id) for r in found.collect()) == [(2, "a", "a"), (2, "a", "b")]


def test_candidates_move_once_to_their_problem(spark, sf):
    """After the place in the order, one exchange for both checks and the votes, in more parts than a shuffle has."""
    said = QUERIES["q_vote"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in said.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moves) == 2 and all("REPARTITION_BY_NUM" in x for x in moves)


def test_sequences_become_text_side_by_side(spark):
    """The task that hashes reads pieces of text from many partitions, whatever their number, and refuses another order."""
    import hashlib

    from sievelight.operators import aggregates, sequences

    rows = spark.range(5_000).repartition(7)
    want = hashlib.sha256(("[" + ",".join(map(str, range(5_000))) + "]").encode()).hexdigest()
    assert [tuple(r) for r in aggregates.sequence_sha256(rows, ["id"], ["id"]).collect()] == [("id", 5_000, want)]
    found = sequences.pieces(rows.repartitionByRange(5, "id").sortWithinPartitions("id"), lambda b: [[str(x) for x in b.column(0).to_pylist()]])
    assert found.select("place").distinct().count() == 5
    with pytest.raises(Exception, match="out of order"):
        sequences.hashed(found.orderBy(F.desc("place")), [b""], lambda s, n, k: None, "x long").collect()


def test_profiles_of_any_size_are_drawn_in_parts(spark, monkeypatch):
    """More kinds of groups than one task may hold: intervals as from a single draw, shared by equal hypotheses, whatever the partitions."""
    import numpy as np

    from sievelight.operators import crossfold, evaluation

    rows = [(i % 3, i % 8 + 1, [i % 9 - 4, i % 9 - 4, i % 7 - 2], i % 5 + 1) for i in range(504)]
    profile = spark.createDataFrame(rows, "fold int, size long, sums array<long>, n long")
    whole = np.array([r.deltas for r in crossfold.stratified_deltas(profile, 4_000, 1).collect()])
    monkeypatch.setattr(evaluation, "MAX_PROFILE", 100)
    monkeypatch.setattr(crossfold, "PARTS", 7)
    one, two = (crossfold.stratified_deltas(profile.repartition(n), 4_000, 1).orderBy("sample").collect() for n in (1, 5))
    parted = np.array([r.deltas for r in one])
    assert one == two and parted.shape == (4_000, 3) and (parted[:, 0] == parted[:, 1]).all()
    assert np.allclose(np.quantile(whole, (0.025, 0.5, 0.975), axis=0), np.quantile(parted, (0.025, 0.5, 0.975), axis=0), atol=0.012)


def test_families_are_counted_by_kind(spark):
    """Gold rows, repeated ids among them, are counted by what the runs say before any hypothesis is made of them."""
    from sievelight.operators import evaluation

    gold = spark.range(400).select((F.col("id") % 390).cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("gold"))
    says = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 11 == 0, "07").otherwise((F.col("id") % F.col("k")).cast("string"))
    runs = spark.range(380).select("id", F.explode(F.array(*map(F.lit, (7, 6, 4)))).alias("k")).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("label"), F.col("id").cast("string").alias("id"), says.alias("prediction"))
    out = evaluation.compare_family(gold, runs, "r7", ["r7", "r6", "r4"])
    said = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in said and "Aggregate" in said[said.index("Generate") :].split("Join")[0]
    right = {(r.label, r.id): r.prediction for r in runs.collect() if r.prediction is not None and (r.prediction == "0" or not r.prediction.startswith("0"))}
    rows = [(r.id, r.gold) for r in gold.collect()]
    ok = lambda x, i, g: right.get((x, i)) == g
    for r in out.collect():
        kind, _, names = r.hypothesis.partition(":")
        a, b = ("r7", names) if kind == "candidate" else names.split("->")
        pairs = [(ok(a, i, g), ok(b, i, g) if kind == "candidate" or (a, i) not in right else ok(a, i, g)) for i, g in rows]
        asked = 0 if kind == "candidate" else sum((a, i) not in right and (b, i) in right for i, _ in rows)
        assert (r.total, r.both, r.only_a, r.only_b, r.neither, r.n_resolved) == (400, pairs.count((True, True)), pairs.count((True, False)), pairs.count((False, True)), pairs.count((False, False)), asked)
    with pytest.raises(Exception, match="repeated"):
        evaluation.compare_family(gold, runs.unionByName(runs.where("id = '3' AND label = 'r4'")), "r7", ["r7", "r4"]).collect()


def test_markers_are_searched_where_their_signs_are(monkeypatch):
    """Only classes whose signs occur in a text are searched; letters that fold to those of a label count as theirs."""
    from sievelight.functions import answers

    asked = []

    class Heard:
        def __init__(self, name, pattern):
            self.name, self.pattern = name, pattern

        def finditer(self, text):
            asked.append(self.name)
            return self.pattern.finditer(text)

    monkeypatch.setattr(answers, "_MARKERS", {k: Heard(k, p) for k, p in answers._MARKERS.items()})
    for text, value, searched in (("#### (12)", "12", ["hashes"]), ("a \\boxed{\\frac{-18}{6}}", "-3", ["boxed"]), ("of them, or 7 / 1", "7", []), ("Anſwer: 5", "5", ["final_answer", "answer"]), ("Fınal anſwer is 4.", "4", ["final_answer"])):
        asked.clear()
        assert (answers.parse_text(text)[1], asked) == (value, searched)


def test_lines_of_a_submission_are_parsed_once(spark):
    from sievelight.operators import validation

    lines = spark.range(5).select(F.col("id").alias("ord"), F.concat(F.lit('{"id":"p'), F.col("id").cast("string"), F.lit('","answer":1}')).alias("raw"))
    found = validation.submission_line_issues(lines, spark.range(4).select(F.col("id").alias("ord"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("id")))
    assert "parse_json" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r.id or "", r.code) for r in found.collect()) == [("", "row_count"), ("p4", "extra_ids")]


def test_coverage_groups_ids_and_not_labels(spark, sf):
    """The runs are read for declared and for other labels, and all labels of an id share one group."""
    from sievelight.operators import crossfold

    assert QUERIES["q_oof_coverage"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 12
    runs = spark.createDataFrame([("a", 0, "1"), ("a", 0, "1"), ("a", 1, "2"), ("b", None, "1"), ("b", 0, "9"), ("c", 0, "1"), (None, 0, "1"), ("a", 0, None)], "label string, fold int, id string")
    wanted = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1)], "id string, fold int")
    got = sorted((r.label or "", r.id or "", r.code) for r in crossfold.coverage_issues(runs, wanted, ["a", "b"]).collect())
    assert got == [("", "1", "undeclared_label"), ("a", "", "extra"), ("a", "1", "duplicate"), ("a", "2", "wrong_fold"), ("a", "3", "missing"), ("b", "1", "wrong_fold"), ("b", "2", "missing"), ("b", "3", "missing"), ("b", "9", "extra"), ("c", "1", "undeclared_label")]


def test_pieces_are_not_searched_one_by_one():
    """Special tokens are looked for in all pieces at once; where one occurs, its piece goes to the library."""
    from sievelight.llm import bpe

    class Counted(list):
        times = 0

        def __iter__(self):
            Counted.times += 1
            return super().__iter__()

    coder = bpe.Coder(bpe.default_path())
    coder.special = Counted(coder.special)
    coder._library([b" word%d" % i for i in range(50)])
    assert Counted.times <= 1


def test_only_ties_between_labels_are_walked(spark, monkeypatch):
    """The rounds get an edge for each id that ties labels together, not one for each member of a label."""
    from sievelight.operators import clusters

    seen = []
    monkeypatch.setattr(clusters, "components", lambda edges, found=clusters.components: (seen.append(edges.count()), found(edges))[1])
    ids = spark.range(2_000).selectExpr("lpad(cast(id as string), 4, '0') AS id")
    n = F.col("id").cast("int")
    labels = ids.select("id", F.explode(F.array(F.concat(F.lit("own"), "id"), F.when(n < 1_990, F.concat(F.lit("k"), (n % 2).cast("string"))), F.when(n.isin(7, 1_000), F.lit("tie")))).alias("label"))
    got = {r.id: r.group_id for r in clusters.build_clusters(ids, labels=labels).collect()}
    assert got == {f"{i:04}": "0000" if i < 1_990 else f"{i:04}" for i in range(2_000)} and seen == [2]


def test_clusters_of_labels_and_pairs_are_those_of_a_union(spark):
    """Random labels (several an id, null, repeated) and pairs, against joining one by one."""
    import random

    from sievelight.operators import clusters

    rnd = random.Random(3)
    for n, n_labels, n_pairs in ((300, 90, 40), (300, 400, 0), (200, 0, 150), (40, 4, 3)):
        ids = [f"{i:03}" for i in range(n)]
        labels = [(rnd.choice(ids), rnd.choice([None, *map(str, range(n_labels))])) for _ in range(n)] * 2 if n_labels else None
        pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(n_pairs)] if n_pairs else None
        top = {i: i for i in ids}

        def find(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        members: dict[str, list[str]] = {}
        for i, k in labels or []:
            if k is not None:
                members.setdefault(k, []).append(i)
        for a, b in [*(pairs or []), *((x, m[0]) for m in members.values() for x in m)]:
            lo, hi = sorted((find(a), find(b)))
            top[hi] = lo
        frame = lambda rows, kind: None if rows is None else spark.createDataFrame(rows, kind)
        got = clusters.build_clusters(frame([(i,) for i in ids], "id string"), frame(pairs, "a string, b string"), frame(labels, "id string, label string"))
        assert {r.id: r.group_id for r in got.collect()} == {i: find(i) for i in ids}


def test_pair_clusters_of_rows_without_source_or_text(spark, tmp_path):
    """A null source or length makes a null label, as in SQL, and joins nothing."""
    rows = [(1, "x", "en", None, 5), (2, "y", "en", None, 5), (3, "z", "en", "a", 5), (4, None, "en", "a", 5), (5, "X", "en", "b", None), (6, "y ", "en", "c", None), (7, "w", "en", "c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().astype({"n_chars": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet", index=False)
    assert compare(spark, connect(str(tmp_path)), "q_pair_clusters", QUERIES["q_pair_clusters"], ORACLE_SQL["q_pair_clusters"], str(tmp_path)) == ""


def test_text_views_keep_steps_from_texts_that_lack_their_signs(spark):
    """The gated chain against the plain one on odd texts; no step is written out for each test that leads to it."""
    import random

    from sievelight.functions import text as T

    def plain(c):
        x = F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit(" "), F.lit(" "))
        x = T._nfkc_folded(x)
        x = F.replace(F.translate(x, T.DASHES + T.DIVIDE, "---/"), F.lit(T.TIMES), F.lit(r"\times"))
        x = F.regexp_replace(F.regexp_replace(x, T.FRACTIONS, r"\\frac"), T.SIZING, "")
        for mark in T.DELIMITERS:
            x = F.replace(x, F.lit(mark), F.lit(""))
        x = F.regexp_replace(F.regexp_replace(x, "(?U)" + T.SPACING, ""), rf"(?U) *[\s\x1c-\x1f&&[^ ]]{T.WS}*| {{2,}}", " ")
        return F.regexp_replace(T.strip(x), f"(?<={T.EDGES}) | (?={T.EDGES})", "")

    def plain_source(x):
        x = F.regexp_replace(x, "(?iU)" + T.EXERCISE_NUMBER, "")
        x = F.when(x.endswith("#"), F.regexp_replace(x, rf"(?U){T.WS}*#{T.WS}*\z", "")).otherwise(x)
        for mark in "?.!":
            x = F.replace(x, F.lit(f" {mark}"), F.lit(mark))
        return T.strip(x)

    bits = [*T.SPACES, *T.DELIMITERS, *T.DASHES, T.TIMES, T.DIVIDE, "\\", "\\,", "\\quad", "\\left", "\\dfrac", "＄", "＼", "\r\n", "#", " ?", " .", "!", "1. ", "٣) ", "Find", "(", "]", "ß", "É", "ﬁ", "a", "bc", *[" "] * 9, *["xy"] * 9]
    rnd = random.Random(1)
    texts = spark.createDataFrame([("".join(rnd.choices(bits, k=rnd.choice((1, 2, 4, 9, 20)))),) for _ in range(4_000)] + [("",), (None,)], "c string").repartition(8)
    new = texts.select("c", T.canonical_text(F.col("c")).alias("x"))
    new = new.select("c", "x", T.source_format_text(F.col("c"), F.col("x")).alias("s")).localCheckpoint()
    old = texts.select("c", plain(F.col("c")).alias("x")).localCheckpoint()
    old = old.select("c", "x", plain_source(F.col("x")).alias("s"))
    assert new.exceptAll(old).count() == 0 and new.count() == old.count()
    said = texts.select(T.canonical_text(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("translate(") < 6


def test_redaction_goes_by_the_first_place_of_a_value(spark, tmp_path):
    """Values that stand in a word before they stand alone, and a question that is a source's name."""
    from sievelight.operators import validation

    texts = ["zz the cats saw the cat", "zz the dog saw the dogs", "zz thenow and now, now", "the cat", "the dog", "now, now", "source", "src1", None, "zz"]
    rows = [(i, t, "en", s, 5) for i, (t, s) in enumerate(zip(texts, ["abc1", "abc2", "abc3", *["source"] * 4, "abc45", "abc45", "abc4"]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{tmp_path}/documents.parquet", index=False)
    assert compare(spark, connect(str(tmp_path)), "q_redaction", QUERIES["q_redaction"], ORACLE_SQL["q_redaction"], str(tmp_path)) == ""
    report, secrets = spark.createDataFrame([(texts[0],), (texts[1],)], "note string"), spark.createDataFrame([("q", "the cat"), ("q", "the dog")], "kind string, value string")
    assert [tuple(r) for r in validation.redaction_issues(report, secrets).collect()] == [("q", "note", 2, 2)]
    assert [tuple(r) for r in validation.redaction_issues(report, secrets, first_place=True).collect()] == [("q", "note", 1, 1)]


def test_packed_lines_end_with_their_lf(spark, tmp_path):
    """The size of a compressed file tells nothing of its bytes: a whole one has no issue, one whose last LF is gone has."""
    import gzip

    from sievelight.sources import jsonl

    for i, (text, bad) in enumerate((('{"a":{"b":1}}\n{"a":2}\n', 0), ('{"a":2}\n{"a":{"b":1}}', 1), ('{"a":2}\n{"a":1', 1), ('{"a":2}\nx\n', 0), ("x\n\n", 0), ("x", 1), ("}\n}\n", 0), ("", 0))):
        (tmp_path / f"a{i}.jsonl.gz").write_bytes(gzip.compress(text.encode()))
        (tmp_path / f"b{i}.jsonl").write_text(text)
        assert [jsonl.unterminated(spark, f"{tmp_path}/{x}").count() for x in (f"a{i}.jsonl.gz", f"b{i}.jsonl")] == [bad, bad], text
    assert sorted(r.path.rsplit("/", 1)[1] for r in jsonl.unterminated(spark, str(tmp_path)).collect()) == ["a1.jsonl.gz", "a2.jsonl.gz", "a5.jsonl.gz", "b1.jsonl", "b2.jsonl", "b5.jsonl"]


def test_packed_bank_is_the_plain_one(spark, tmp_path):
    import gzip

    from sievelight.sources import sinks

    plan = spark.range(500).select((500 - F.col("id")).alias("ord"), F.format_string("train-%06d", "id").alias("problem_id"), F.sha2(F.col("id").cast("string"), 256).alias("question_sha256"))
    accepted = plan.select("problem_id", F.concat(F.lit("ü\n"), "problem_id").alias("target_text"), *(F.lit(c).alias(c) for c in ("provider", "model_id", "model_revision", "prompt_sha256", "execution_sha256", "agent_message_sha256")), F.lit(5).alias("seed"))
    a, b = (sinks.write_source_bank(plan, accepted, str(tmp_path / c), compression=c) for c in ("none", "gzip"))
    assert a == b
    plain, packed = (sorted((tmp_path / c).glob("part-*")) for c in ("none", "gzip"))
    assert "".join(p.read_text() for p in plain) == "".join(gzip.decompress(p.read_bytes()).decode() for p in packed)
    assert sum(p.stat().st_size for p in packed) * 4 < sum(p.stat().st_size for p in plain)
    rows = sinks.load_source_bank(spark, str(tmp_path / "gzip"), plan).collect()
    assert [(r.problem_id, r.teacher.sample_index) for r in rows] == [(f"train-{499 - i:06d}", i) for i in range(500)]


def test_numbers_and_issues_come_from_one_pass(spark, tmp_path):
    """Settled rows have their places and aren't moved again; all issues of lines come from one strict reading."""
    from sievelight.operators import ledger
    from sievelight.sources import jsonl

    rows = ledger.in_order(spark.range(1_000).select((F.col("id") * 7 % 1_001).alias("k")).repartition(7), "k")
    assert [tuple(r) for r in rows.orderBy("rn").collect()] == [(k, i + 1) for i, k in enumerate(sorted(i * 7 % 1_001 for i in range(1_000)))]
    assert "row_number" not in rows._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "a.jsonl").write_text("{}\n")
    _, issues = jsonl.load_rationales(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([(1, "train-000001")], "ord long, problem_id string"))
    assert "strict_json" not in issues._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id or "", r.code) for r in issues.collect()) == [("", "key_set"), ("train-000001", "missing")]


def test_digests_move_as_bytes_and_come_back(spark, tmp_path):
    """Any text comes back as it was; the bank is written where its rows were settled, without an exchange."""
    from sievelight.functions import text as T
    from sievelight.sources import sinks

    rows = spark.createDataFrame([(x,) for x in ("00ff", "0a1B", "abc", "", "é", "ab\n", "cafe" * 16, None)], "c string")
    packed = rows.select("c", T.packed_hex(F.col("c")).alias("p"))
    assert packed.where(~T.unpacked_hex(F.col("p")).eqNullSafe(F.col("c"))).count() == 0 and packed.where("p.bytes IS NOT NULL").count() == 2
    plan = spark.range(50).select("id", F.col("id").alias("ord"), F.col("id").cast("string").alias("problem_id"), F.sha2(F.col("id").cast("string"), 256).alias("question_sha256"))
    accepted = plan.select("problem_id", *(F.lit(c).alias(c) for c in ("target_text", "provider", "model_id", "model_revision", "prompt_sha256", "execution_sha256", "agent_message_sha256")), F.col("id").alias("seed"))
    bank = sinks.source_bank(plan, accepted)
    said = bank._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in said and "SortMergeJoin" not in said and bank.where("question_sha256 = sha2(problem_id, 256) AND teacher.sample_index = ord").count() == 50


@pytest.mark.parametrize("carried, block", ((32, 500), (20, 30)))
def test_redaction_of_long_cells(spark, monkeypatch, carried, block):
    """A place carries little of its cell; values of every length are found in every part of it, across all borders."""
    from sievelight.operators import validation

    monkeypatch.setattr(validation, "CARRIED", carried)
    monkeypatch.setattr(validation, "CELL_BLOCK", block)
    cell = " ".join(f"w{i * 7919 % 100_003}" for i in range(2_500))
    values = [cell[a:b] for a in (0, 489, 990, 7_300, len(cell) - 700) for n in (6, 7, 99, 100, 101, 600, 1_700) if (b := a + n) <= len(cell)] + [cell, cell[-6:], cell[:150] + "x", cell[1:] + "y"]
    word = lambda x, y: x.isalnum() and y.isalnum()
    want = {v for v in values if any(cell.startswith(v, p) and not (p and word(v[0], cell[p - 1])) and not (p + len(v) < len(cell) and word(v[-1], cell[p + len(v)])) for p in range(len(cell)))}
    secrets = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "kind string, value string")
    found = validation.redaction_issues(spark.createDataFrame([(cell,)], "note string"), secrets)
    assert {values[int(r.kind)] for r in found.collect()} == want and 2 < len(want) < len(values)
