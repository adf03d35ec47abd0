"""Sequential models of the rules: one bundle or patch after another."""

from __future__ import annotations


def route(bundles, state=None):
    """Fold bundles over a store of active records; returns outcomes by seq."""
    store = dict(state or {})
    out = {}
    for b in sorted(bundles, key=lambda b: b["seq"]):
        key = (b["csi_id"], b["region"], b["regulation"], b["json_name"])
        cur = store.get(key)
        if cur is None:
            store[key] = {"version": 1, "sql_name": b["sql_name"], "tpl_name": b["tpl_name"],
                          "sums": (b["json_sum"], b["sql_sum"], b["tpl_sum"]),
                          "origin": b["seq"]}
            out[b["seq"]] = ("created", "new record", 1, b["sql_name"], b["tpl_name"], b["seq"])
            continue
        new = (b["json_sum"], b["sql_sum"], b["tpl_sum"])
        if new == cur["sums"]:
            status, reason = "skipped", "checksums unchanged"
        else:
            names = ("json_config", "sql_file", "template")
            differ = [n for n, x, y in zip(names, new, cur["sums"]) if x != y]
            status, reason = "updated", "changed: " + ", ".join(differ)
            really = [n for n in differ if n != "template" or b["tpl_sum"] is not None]
            if really:
                cur = dict(cur, version=cur["version"] + 1)
                if "sql_file" in really:
                    cur["sql_name"] = b["sql_name"]
                if "template" in really:
                    cur["tpl_name"] = b["tpl_name"]
                tpl = b["tpl_sum"] if b["tpl_sum"] is not None else cur["sums"][2]
                cur["sums"] = (b["json_sum"], b["sql_sum"], tpl)
                store[key] = cur
        out[b["seq"]] = (status, reason, cur["version"], cur["sql_name"], cur["tpl_name"],
                         cur["origin"])
    return out, store


def patch(patches, records):
    """Fold patches over records by report id; claims as documented."""
    held = {(*r["key3"], r["json_name"]): rid for rid, r in records.items()}
    first = {}
    start = {rid: r["json_name"] for rid, r in records.items()}
    for p in sorted(patches, key=lambda p: p["seq"]):
        r = records.get(p["report_id"])
        if r and p["json_name"] and p["json_name"] != start[p["report_id"]]:
            first.setdefault((*r["key3"], p["json_name"]), p["report_id"])
    now = {rid: dict(r) for rid, r in records.items()}
    out = {}
    for p in sorted(patches, key=lambda p: p["seq"]):
        rid = p["report_id"]
        brought = [f for f in ("json", "sql", "tpl") if p[f"{f}_sum"]]
        r = now.get(rid)
        if not brought or r is None:
            out[p["seq"]] = ("failed", None)
            continue
        if "json" in brought and p["json_name"] != start[rid]:
            key = (*r["key3"], p["json_name"])
            if held.get(key, first[key]) != rid:
                out[p["seq"]] = ("failed", None)
                continue
        r["version"] += 1
        for f in brought:
            r[f"{f}_name"], r[f"{f}_sum"] = p[f"{f}_name"], p[f"{f}_sum"]
        if "json" in brought:
            r["name"] = p["name"]
        out[p["seq"]] = ("updated", (r["version"], r["name"], r["json_name"], r["sql_name"],
                                     r["tpl_name"], r["tpl_sum"]))
    return out


def mixed(rows, records):
    """Fold bundles and patches over records by report id, one after another."""
    now = {rid: dict(r) for rid, r in records.items()}
    out = {}

    def at(key3, name):
        held = [i for i, r in now.items() if r["key3"] == key3 and r["json_name"] == name]
        assert len(held) < 2
        return held[0] if held else None

    for p in sorted(rows, key=lambda p: p["seq"]):
        brought = [f for f in ("json", "sql", "tpl") if p[f"{f}_sum"]]
        key3 = (p["csi_id"], p["region"], p["regulation"])
        if p["kind"] == "bundle":
            rid = at(key3, p["json_name"])
            if rid is None:
                rid = p["own"]
                now[rid] = {"key3": key3, "version": 1, "name": p["name"]} | {
                    f"{f}_{c}": p[f"{f}_{c}"] for f in ("json", "sql", "tpl") for c in ("name", "sum")
                }
                status = "created"
            else:
                r = now[rid]
                differ = [f for f in ("json", "sql", "tpl") if p[f"{f}_sum"] != r[f"{f}_sum"]]
                really = [f for f in differ if p[f"{f}_sum"]]
                status = "updated" if differ else "skipped"
                r["version"] += bool(really)
                r["name"] = p["name"]
                for f in really:
                    r[f"{f}_name"], r[f"{f}_sum"] = p[f"{f}_name"], p[f"{f}_sum"]
        else:
            rid = p["report_id"] if p["kind"] == "patch_id" else at(key3, p["json_name"])
            r = now.get(rid)
            taken = r and "json" in brought and at(r["key3"], p["json_name"]) not in (None, rid)
            if not brought or r is None or taken:
                out[p["seq"]] = ("failed", None)
                continue
            r["version"] += 1
            for f in brought:
                r[f"{f}_name"], r[f"{f}_sum"] = p[f"{f}_name"], p[f"{f}_sum"]
            r["name"] = p["name"] if "json" in brought else r["name"]
            status = "updated"
        r = now[rid]
        out[p["seq"]] = (status, (rid, r["version"], r["name"], r["json_name"], r["json_sum"],
                                  r["sql_name"], r["sql_sum"], r["tpl_name"], r["tpl_sum"]))
    return out


def purge(versions, keep):
    """Rows to purge, group by group."""
    groups = {}
    for v in versions:
        groups.setdefault((v["csi_id"], v["region"], v["regulation"]), []).append(v)
    gone = set()
    for rows in groups.values():
        slots = max(0, keep - sum(v["active"] for v in rows))
        idle = [v for v in rows if not v["active"]]
        idle.sort(key=lambda v: v["report_id"])
        idle.sort(key=lambda v: (v["version"], v["uploaded_at"]), reverse=True)
        gone |= {(v["report_id"], v["version"]) for v in idle[slots:]}
    return gone
