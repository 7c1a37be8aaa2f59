"""A plain model of the selection rule, for differential tests."""


def order(e):
    return (e["event_time_us"], e["system_time_us"], e["sequence_no"])


def key(e):
    return (e["tenant_id"], e["entity_type"], e["entity_id"], e["feature_id"])


def winner(events, e_cut=None, s_cut=None):
    seen = [e for e in events if (e_cut is None or e["event_time_us"] <= e_cut) and (s_cut is None or e["system_time_us"] <= s_cut)]
    best = max(seen, key=order, default=None)
    return None if best is None or best["operation"] == "DELETE" else best


def latest_n(events, n):
    ranked = sorted(events, key=order, reverse=True)
    if not ranked or ranked[0]["operation"] == "DELETE":
        return []
    return [e["value"] for e in ranked if e["operation"] != "DELETE"][:n]


def revisions(events, s_cut):
    times = {}
    for e in events:
        if e["system_time_us"] <= s_cut:
            old = times.get(e["event_time_us"])
            if old is None or (e["system_time_us"], e["sequence_no"]) > (old["system_time_us"], old["sequence_no"]):
                times[e["event_time_us"]] = e
    return [e for _, e in sorted(times.items()) if e["operation"] != "DELETE"]


def admitted(batches, seen=()):
    taken, out = set(seen), []
    for batch, ids in batches:
        if not taken & set(ids):
            taken |= set(ids)
            out.append(batch)
    return out
