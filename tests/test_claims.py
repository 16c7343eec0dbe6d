"""Claims in Chinese and Latin text: each rule, and what it must not say."""

import pytest

from quillspark.operators import claims as C

A, H, Y, N = 1, 2, 4, 8
CASES = [
    ("Ada is in Port Mira while it rains.", "Ada", False, [("location", "Port Mira", 10, 0.9, 1.1, A)]),
    ("Once Ada was at The Gate of Brass, they say.", "Ada", False, [("location", "The Gate of Brass", 16, 0.9, 1.1, H)]),
    ("If Ada walked to 'home' all ends.", "Ada", False, []),
    ("If Ada walked to Rome all would end.", "Ada", False, [("location", "Rome", 17, 0.9, 1.1, Y)]),
    ("Ada never sleeps, Ada joined The Order of the Sun.", "Ada", False, [("affiliation", "The Order of the Sun", 29, 0.85, 1.0, A)]),
    ("Ada became Captain of all.", "Ada", False, [("role", "captain", 11, 0.9, 1.0, A)]),
    ("Ada was killed. Ada is alive.", "Ada", False, [("life_state", "dead", 0, 1.0, 1.0, A), ("life_state", "alive", 16, 1.0, 1.0, A)]),
    ("Ada is missing; Ada is unconscious.", "Ada", False, [("life_state", "missing", 0, 1.0, 1.0, A), ("life_state", "incapacitated", 16, 0.9, 1.0, A)]),
    ("Ada, as they all say, is dead.", "Ada", False, []),
    ("Orb belongs to Bob.", "Orb", True, [("owner", "Robert", 15, 0.9, 1.0, A)]),
    ("Orb is with bob.", "Orb", True, []),
    ("Orb is in Rome.", "Orb", True, []),
    ("Ada is in", "Ada", False, []),
    ("林月不在西城门，却在北书院里。", "林月", False, [("location", "西城门", 0, 0.9, 1.0, N), ("location", "北书院", 10, 0.9, 1.1, A)]),
    ("林月如今在老人的旧街。", "林月", False, [("location", "旧街", 5, 0.9, 1.1, A)]),
    ("听说林月加入了青山宗。", "林月", False, [("affiliation", "青山宗", 6, 0.85, 1.0, Y)]),
    ("林月是青山派弟子。", "林月", False, [("affiliation", "青山派", 3, 0.85, 1.0, A)]),
    ("林月担任大长老。", "林月", False, [("role", "大长老", 4, 0.9, 1.0, A)]),
    ("林月已经失踪。林月没有昏迷。", "林月", False, [("life_state", "missing", 0, 1.0, 1.0, A), ("life_state", "incapacitated", 7, 0.9, 1.0, N)]),
    ("林月曾在这座城。", "林月", False, []),
    ("宝剑归王五手中。", "宝剑", True, [("owner", "王五", 3, 0.9, 1.0, A)]),
    ("林月在西城门。林月可能在西城门。", "林月", False, [("location", "西城门", 3, 0.9, 1.1, A | Y)]),
]


@pytest.fixture
def made(spark):
    segments = spark.createDataFrame([(k, k % 3, t) for k, (t, *_) in enumerate(CASES)] + [(98, 0, None), (99, 0, "")], "segment long, chapter long, content string")
    places = []
    for k, (text, name, artifact, _) in enumerate(CASES):
        at = text.find(name)
        while at >= 0:
            places += [(k, at, at + len(name), 7, artifact)] * 2
            at = text.find(name, at + 1)
    places += [(98, 0, 3, 7, False), (99, 0, 3, 7, None), (1000, 0, 3, 7, False)]
    found = spark.createDataFrame(places, "segment long, start long, end long, target_id long, artifact boolean")
    return found, segments, spark.createDataFrame([("Bob", "Robert"), ("captain", "no")], "surface string, canonical string")


def test_claims_of_each_rule(made):
    rows = C.claims(*made).collect()
    for k, (text, _, _, want) in enumerate(CASES):
        got = sorted(((r.slot, r.value, r.anchor, r.confidence, r.salience, r.cues) for r in rows if r.segment == k), key=lambda c: c[2])
        assert got == want, text
    assert {r.segment for r in rows} <= set(range(len(CASES)))
    for chapter in range(3):
        mine = sorted((r for r in rows if r.chapter == chapter), key=lambda r: r.claim_id)
        assert [r.claim_id for r in mine] == list(range(1, len(mine) + 1)) and [(r.segment, r.anchor) for r in mine] == sorted((r.segment, r.anchor) for r in mine)


def test_no_matches(made):
    found, segments, names = made
    assert C.claims(found.filter("false"), segments, names).count() == 0


def test_each_step_of_a_value_is_worked_out_once(made):
    plan = C.claims(*made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|".join(C.LEADING)) == 1 and plan.count(C.DETERMINER) == 1
