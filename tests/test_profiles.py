"""Profiles of projects against a walk through the log in order."""

import datetime as dt
import random

from quillspark.operators import profiles as P
from quillspark.plans import profiles as plans

SCHEMA = "event_id long, user_id long, event string, project_id long, created_at timestamp_ntz, meta map<string,string>"


def log(spark, n=1500):
    rnd = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    values = lambda *v: rnd.choice([None, "", " ", *v])
    rows = []
    for k in range(n):
        meta = {"start_mode": values("chapter_import", "blank"), "channel": values(" c1 ", "c2"), "source_surface": values("s"), "count": values("3", "0", "-2", "2.0", "x"), "success_count": values("0", "2"), "applied_count": values("4", "-1"), "step": values("write", "atlas"), "referrer_host": values("h" * 300)}
        rows.append((k, rnd.choice([None, 1, 2, 3, 4]), rnd.choice(plans.NAMES), rnd.choice([None, 1, 2]), day + dt.timedelta(hours=rnd.randrange(300)), None if k % 50 == 0 else meta))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), sorted(rows, key=lambda r: (r[4], r[0]))


def walk(rows):
    out, signup = {}, {}
    for _, user, event, project, at, meta in rows:
        get = lambda key: ((meta or {}).get(key) or "").strip()[:240] or None  # noqa: B023, E731
        whole = lambda key: int(float(get(key))) if get(key) not in (None, "x") else None  # noqa: B023, E731
        if event == P.SIGNUP and user is not None:
            signup.setdefault(user, {a: get(a) for a in P.ATTRIBUTION})
        if user is None or project is None:
            continue
        p = out.setdefault((user, project), {"first_seen_at": at, "counts": {}, "draft_confirm_count": 0, "copilot_apply_count": 0, "first_value_at": None, "project_start_at": None, "generated": False, "write": 0})
        p["counts"][event] = p["counts"].get(event, 0) + 1
        if event == P.START:
            p["project_start_at"] = p["project_start_at"] or at
            for name, key in [("project_start_mode", "start_mode"), *((a, a) for a in P.ATTRIBUTION)]:
                p[name] = get(key) or p.get(name)
        elif event == "draft_confirm":
            p["draft_confirm_count"] += max(1, whole("count") or 1)
        elif event == P.APPLY:
            p["copilot_apply_count"] += max(0, whole("success_count") or whole("applied_count") or 0)
        elif event == P.GENERATION:
            p["generated"] = True
        elif event == P.SAVE and p["generated"]:
            p["first_value_at"] = p["first_value_at"] or at
        elif event == P.STEP:
            p["write"] += get("step") == "write"
    for (user, _), p in out.items():
        for a in P.ATTRIBUTION:
            p[a] = p.get(a) or signup.get(user, {}).get(a)
        p["project_start_at"] = p["project_start_at"] or p["first_seen_at"]
        p["project_start_mode"] = p.get("project_start_mode") or "unknown"
    return out


def test_profiles(spark):
    df, rows = log(spark)
    want = walk(rows)
    got = {(r.user_id, r.project_id): r for r in P.profiles(df).collect()}
    assert got.keys() == want.keys() and len(got) == 8
    for key, p in want.items():
        r = got[key].asDict()
        plain = {k: v for k, v in p.items() if k not in ("counts", "generated", "write")}
        assert {k: r[k] for k in plain} == plain
        assert {c: r[c] for c in P.COUNTS} == {c: p["counts"].get(e, 0) for c, e in P.COUNTS.items()}
        assert r["demo_guide_step_write_count"] == p["write"] and r["first_value_completed"] == (p["first_value_at"] is not None)
        assert r["world_model_activated"] == any(e in p["counts"] for e in P.ACTIVATION) and r["copilot_applied"] == (p["copilot_apply_count"] > 0)
        assert r["demo_guide_completed"] == ("demo_guide_completed" in p["counts"])
    found = P.profiles(df)
    summed = P.segments(found).collect()
    assert sum(r.projects for r in summed) == len(want) and sum(r.generated_projects for r in summed) == sum(p["generated"] for p in want.values())
    assert len(P.derived_metrics(found).collect()) == 7
    first = {}
    for (user, _), r in got.items():
        if r.demo_guide_completed_at:
            first[user] = min(first.get(user, r.demo_guide_completed_at), r.demo_guide_completed_at)
    clicks = [r for r in rows if r[2] == P.CLICK and r[1] in first and r[4] >= first[r[1]]]
    after = {r.metric: (r.users, r.n) for r in P.after_demo(df, found).collect()}
    assert after["demo_guide_to_upload_click"] == (len({c[1] for c in clicks}), len(clicks)) and clicks


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.profiles(none).count() == 0 and P.segments(P.profiles(none)).count() == 0
    assert sorted(map(tuple, P.after_demo(none, P.profiles(none)).collect())) == [("demo_guide_to_chapter_import", 0, 0), ("demo_guide_to_upload_click", 0, 0)]
