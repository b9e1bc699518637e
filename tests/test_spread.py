from scoreloom.operators import text as tx
from scoreloom.plans import business, resumes


def test_documents_of_a_file_with_one_row_group_are_written_by_many_tasks(spark, sf):
    docs = resumes.written(spark, sf)
    assert business.table(spark, sf, "customer").rdd.getNumPartitions() == 1
    assert docs.rdd.getNumPartitions() >= 4 and tx.lines(docs).rdd.getNumPartitions() >= 4


def test_pairs_made_from_a_file_with_one_row_group_are_compared_by_many_tasks(spark, sf):
    assert resumes.order_similarity_rotated(spark, sf).rdd.getNumPartitions() >= 4


def test_education_reads_its_blocks_once(spark, sf):
    from scoreloom.operators import extract

    lines = resumes.written_lines(spark, sf)
    assert "Union" not in extract.education(lines)._jdf.queryExecution().optimizedPlan().toString()


def test_checks_are_dealt_over_many_tasks(spark, sf):
    from scoreloom.plans import textual

    checks = textual.checks_all(spark, sf)
    assert checks.rdd.getNumPartitions() >= 4


def test_fixes_sort_once_by_group_and_once_by_points(spark, sf):
    from scoreloom.plans import textual

    plan = textual.check_fixes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") == 2
