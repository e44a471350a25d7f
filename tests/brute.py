"""Plain-Python rankings, used to check the Spark plans on small inputs."""

from statistics import median, stdev

import numpy as np


def rankings(plays, occasions, items, spec, as_of, last_seq):
    """plays: dicts with occasion_id, item_id, position, is_repeat, is_original; occasions: id -> (seq, date)."""
    from datetime import timedelta

    dated = [dict(p, seq=occasions[p["occasion_id"]][0], day=occasions[p["occasion_id"]][1])
             for p in plays if p["occasion_id"] in occasions and p["item_id"] is not None
             and p["item_id"] not in spec.history_blacklist]
    dated.sort(key=lambda p: (str(p["item_id"]), p["seq"], p["position"], p["is_repeat"]))
    if spec.repeat_policy == "dedupe_before":
        seen, unique = set(), []
        for p in dated:
            if (p["item_id"], p["seq"]) not in seen:
                seen.add((p["item_id"], p["seq"]))
                unique.append(p)
        dated = unique
    before = {}
    for p in dated:
        prev = before.get(p["item_id"])
        p["gap"] = None if prev is None else p["seq"] - prev
        before[p["item_id"]] = p["seq"]
    if spec.repeat_policy == "flag_after":
        dated = [p for p in dated if p["is_repeat"] == 0]
    for p in dated:
        if spec.by_item_name:
            item = items.get(p["item_id"])
            flag = {"item": item and item[1], "play": p["is_original"], None: None}[spec.flag_source]
            p["key"] = None if item is None or (spec.flag_source and flag is None) else (item[0], flag)
        else:
            p["key"] = (p["item_id"], None)

    def stats(chosen):
        groups = {}
        for p in chosen:
            if p["key"] is not None:
                groups.setdefault(p["key"], []).append(p)
        for (name, flag), ps in groups.items():
            if spec.originals_only and flag != 1:
                continue
            if name in spec.result_blacklist:
                continue
            gaps = [p["gap"] for p in ps if p["gap"] is not None]
            last = max(ps, key=lambda p: p["seq"])
            r = lambda x: None if x is None else float(np.round(x, 2))
            yield dict(
                item=name, n=len(ps), ltp=last["day"], current=last_seq - last["seq"],
                avg=r(sum(gaps) / len(gaps)) if gaps else None, med=r(float(median(gaps))) if gaps else None,
                std=r(stdev(gaps)) if len(gaps) > 1 else None,
            )

    overdue = []
    for s in stats(dated):
        if s["n"] <= spec.min_plays:
            continue
        if spec.active_days is not None and not s["ltp"] > as_of - timedelta(days=spec.active_days):
            continue
        z = None
        if s["std"] is not None:
            diff = s["current"] - s["avg"]
            z = diff / s["std"] if s["std"] else (float("inf") if diff > 0 else float("-inf") if diff < 0 else None)
        overdue.append((s, z))
    overdue.sort(key=lambda t: (t[1] is None, -(t[1] or 0), str(t[0]["item"])))
    since = as_of - timedelta(days=spec.window_days)
    rotation = [s for s in stats([p for p in dated if p["day"] > since]) if s["current"] > spec.min_current_gap]
    rotation.sort(key=lambda s: (-s["n"], str(s["item"])))
    return (
        [(s["item"], s["n"], s["ltp"], s["current"], s["avg"], s["med"], s["current"] - s["avg"], s["current"] - s["med"])
         for s, _ in overdue],
        [(s["item"], s["n"], s["ltp"], s["current"], s["avg"], s["med"]) for s in rotation],
    )
