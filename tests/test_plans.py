"""Plans of queries that compute much for each row: over all tasks, and each text once."""

from lexmill.plans import catalog
from tests.compare import DATA


def _plan(spark, name: str) -> str:
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_archive_preranking_folds_each_text_once_and_in_many_tasks(spark):
    plan = _plan(spark, "archive_preranking")
    assert plan.count("regexp_replace(") == 5
    assert "Repartition" in plan


def test_local_search_scores_once_and_in_many_tasks(spark):
    plan = _plan(spark, "local_search")
    assert plan.count("regexp_replace(") == 4
    assert plan.count("round(") == 1
    assert plan.index("round(") < plan.index("Repartition") < plan.rindex("Project")
