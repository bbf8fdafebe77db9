"""The timeline from dates and placements, end to end."""

from skeinwork.operators import timeline

DATED = "index int, pos int, system string, parts array<int>, anchor_relative boolean"
PLACED = "ord int, gap_id string, pos int, index int"


def test_order_history(spark):
    texts = ["342 AR", "1 AR", "year 9", None, None, None, "200 years ago", "12 AR", None, "3 BR"]
    events = spark.createDataFrame(list(enumerate(texts)), "index int, date_text string")
    dated = spark.createDataFrame(
        [
            (0, 0, "AR", [342], False), (0, 1, "AR", [1], False), (1, 2, "AR", [1], False), (2, 3, "years ago", [9], False), (3, 4, "AR", [5], False), (6, 5, "AR", [1224], True),
            (7, 6, "AR", [13], False), (9, 7, "", [3], False), (9, 8, "BR", [3, -1], False), (99, 9, "AR", [1], False), (9, 10, "BR", [3], None),
        ],
        DATED,
    )
    placed = spark.createDataFrame(
        [(0, "AR#1", 0, 4), (0, "AR#1", 1, 4), (1, "(undated)#0", 0, 5), (2, "AR#1", 0, 3), (3, "AR#9", 0, 8), (4, "AR#0", 0, 4), (4, "AR#0", 1, 0), (5, "AR#3", 0, 77), (6, "(undated)#0", 0, 2)], PLACED
    )
    got = {r["index"]: (r.calendar_system, r.chronological_position) for r in timeline.order_history(events, dated, placed).collect()}
    assert got == {
        1: ("AR", 0), 4: ("AR", 1), 3: ("AR", 2), 0: ("AR", 3), 6: ("AR", 4), 9: ("BR", 0), 5: (None, 0), 2: (None, 1), 7: (None, None), 8: (None, None),
    }
    bare = timeline.order_history(events, dated.limit(0), placed.limit(0)).collect()
    assert len(bare) == 10 and all(r.chronological_position is None for r in bare)
