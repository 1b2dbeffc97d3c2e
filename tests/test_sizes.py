"""Tables that grow with the input are shuffled, never sent through the driver by the planner's guess of their size."""

import __spark_entry__ as entry
from changelens import fixtures as fx
from changelens.operators import impact, links, symbols
from changelens.operators.grouping import broadcast_if_small


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_import_links_are_shuffled(spark):
    files = fx.source_files(spark, entry.SMALL)
    facts = symbols.with_source_facts(files).select("repo", "sha", "path", "language", "imports")
    targets = files.selectExpr("repo", "sha", "path AS target")
    assert "Broadcast" not in _plan(links.link_files(facts, targets))


def test_more_rows_than_the_bound_are_shuffled(spark):
    left = spark.range(100)
    assert "Broadcast" not in _plan(left.join(broadcast_if_small(spark.range(10), 9), "id"))
    assert "Broadcast" in _plan(left.join(broadcast_if_small(spark.range(10), 10), "id"))


def test_impact_joins_are_shuffled(spark):
    from changelens.plans import impact as plan

    changed, files = fx.symbol_changes(spark, entry.SMALL), fx.source_files(spark, entry.SMALL)
    found = plan.impact(changed, files)
    used = impact.in_changed_file(impact.group_callers(impact.uses(found.symbols, symbols.hits(found.scanned))), changed)
    for table in (impact.link_tier(used, found.scanned, symbols.definers(found.scanned)), found.symbol_impact, found.stats):
        assert "Broadcast" not in _plan(table)


def test_report_lines_are_read_once(spark):
    """What several parts of a finding need is evaluated once per line, and the feedback text once per comment."""
    from changelens.functions import text as tx
    from changelens.queries import QUERIES, load

    load()
    read = spark.createDataFrame([("x",)], "b string").select(tx.parse_report_findings("b"))
    assert read._jdf.queryExecution().analyzed().toString().count("translate(") <= 6
    told = QUERIES["C36_feedback_text"](spark, entry.SMALL)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("A maintainer rated") == 1


def test_request_texts_are_built_once(spark):
    """The patch's and the message's credentials are each redacted in one place of the plan."""
    from changelens.queries import QUERIES, load

    load()
    longest = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "50000000")
    plan = QUERIES["C32_render_prompt"](spark, entry.SMALL)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", longest)
    assert plan.count("AKIA") == 2


def test_two_trees_meet_in_one_shuffle(spark):
    """lines are compared where their file is; only the texts of a file move."""
    from changelens.operators import diff

    base = spark.createDataFrame([("1", "a", "x\nx\ny\nz"), ("1", "gone", "x"), ("1", "same", "q"), ("1", "turned", "a\nb"), ("2", "empty", "")], "case string, path string, content string")
    head = spark.createDataFrame([("1", "a", "x\ny\ny\ny\nw"), ("1", "new", "n\nn"), ("1", "same", "q"), ("1", "turned", "b\na"), ("2", "empty", None)], "case string, path string, content string")
    files, lines = diff.line_diff(base, head)
    for table in (files, lines):
        assert table._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, lines.collect())) == [
        ("1", "a", "+", 3, "y"), ("1", "a", "+", 4, "y"), ("1", "a", "+", 5, "w"), ("1", "a", "-", 2, "x"), ("1", "a", "-", 4, "z"),
        ("1", "gone", "-", 1, "x"), ("1", "new", "+", 1, "n"), ("1", "new", "+", 2, "n"),
    ]
    assert sorted(map(tuple, files.collect())) == [
        ("1", "a", "modified", 3, 2), ("1", "gone", "removed", 0, 1), ("1", "new", "added", 2, 0), ("1", "turned", "modified", 0, 0), ("2", "empty", "removed", 0, 0),
    ]


def test_added_numbers_come_from_the_patch_itself(spark):
    """line numbers need no row of the patch put in order, and an answer's text is cut out once."""
    from changelens.functions import diffs
    from changelens.functions import text as tx

    odd = ["@@ -1,3 +5,4 @@ f\n a\n-b\n+c\n\\ No newline\n+d\n@@ -9 +20 @@\n-x\r\n+y\n+", "no header\n+a", "", None, "@@ -0,0 +1 @@", "@@ -3,1 +2,0 @@\n-only\n-gone\n"]
    patches = spark.createDataFrame([(p,) for p in odd], "patch string")
    both = patches.select(diffs.added_numbers("patch").alias("now"), diffs.added_lines(diffs.patch_rows("patch")).alias("by_rows"))
    assert both.filter("NOT (now <=> by_rows)").count() == 0 and both.first()["now"] == [6, 7, 20, 21]
    plan = lambda column: patches.select(column.alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan(diffs.added_numbers("patch"))
    assert plan(tx.json_object_text("patch")).count("regexp_extract(") == 1


def test_a_publication_collects_its_reviews_once(spark, monkeypatch):
    """the findings that are verified and the files that are published come from one collection."""
    from changelens.queries import jobs

    calls, real = [], jobs.review.collect_reviews
    monkeypatch.setattr(jobs.review, "collect_reviews", lambda *args, **named: calls.append(1) or real(*args, **named))
    jobs._publication(spark, entry.SMALL)
    assert len(calls) == 1


_JOB_PARTS = (
    "C22_render_evidence", "C23_impact_headline", "E16_impact_stats", "E3_group_callers", "E4_symbol_counts", "E5_test_files", "E6_other_definitions", "F11_evidence_sections",
    "F15_parse_cap", "D10_drop_redundant_imports", "D7_enclosing_definition", "D8_drop_own_body", "F9_top_callers", "G5_defines_searched",
)


def test_no_part_of_the_scan_or_the_impact_job_is_broadcast_by_guess(spark, monkeypatch):
    """F2 to F8, F10, F12, F14, F20 to F23: beyond the counted bounds nothing goes through the driver, neither in a query's last step nor in a table it writes on the way."""
    from changelens.plans import impact as plan
    from changelens.queries import QUERIES, joins, load

    load()
    written, real = [], symbols.materialize
    for module in (symbols, impact):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, max_rows, weight=None: broadcast_if_small(df, -1, weight))
    for module in (symbols, plan, joins):
        monkeypatch.setattr(module, "materialize", lambda df: written.append(df) or real(df))
    for job in (joins.scan_all, joins.run_impact):
        job.cache_clear()
    try:
        plans = {name: _plan(QUERIES[name](spark, entry.SMALL)) for name in _JOB_PARTS}
    finally:
        for job in (joins.scan_all, joins.run_impact):
            job.cache_clear()
    assert [name for name, text in plans.items() if "Broadcast" in text] == []
    assert len(written) >= 10 and not any("Broadcast" in _plan(df) for df in written)
