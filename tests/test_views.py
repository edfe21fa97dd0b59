"""Views over the tables."""

from gristmill.plans import views

SF = "/root/testdata/sf0.001"


def test_lineitems_are_not_dealt_by_customer(spark):
    # orders meet their customers before the many lineitems meet orders
    lines = views.stack_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Join" in line and "c_custkey" in line)
    below = []
    for line in lines[at + 1 :]:
        if depth(line) <= depth(lines[at]):
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)
    assert views.stack_rows(spark, SF).count() == views.table(spark, SF, "lineitem").count()
