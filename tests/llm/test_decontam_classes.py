from helpers import docs
from test_decontam import items

from meterlake.llm.decontam_template import contaminated, drop_contaminated, item_classes

TANK = "The tank holds {} litres and loses {} litres each hour until it is empty."


def test_each_slot_vector_of_a_template_is_checked(spark):
    bench = items(spark, [TANK.format(5, 5), TANK.format(9, 4), TANK.format(9, 4), "..."])
    rows = docs(spark, [(1, "So: " + TANK.format(9, 4)), (2, TANK.format(5, 5)), (3, "clean")])
    got = {(r.doc_id, r.item_id): r.consistent for r in contaminated(rows, bench).collect()}
    # item 0's one value would stand for two in document 1; item 1 allows both documents
    assert set(got) == {(1, 1), (2, 0), (2, 1)} and got[1, 1] == 1
    assert [r.doc_id for r in drop_contaminated(rows, bench).collect()] == [3]
    assert {(r.item_id, r.class_id) for r in item_classes(bench).collect()} == {(0, 0), (1, 1), (2, 1)}
