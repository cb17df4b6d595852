"""One-packet-at-a-time model of the chain, for comparison with the Spark jobs.

Written from the definitions in plain Python, with whole histories kept and
looked back on, so that it shares no method with the code under test.
"""

import hashlib
import math
from collections import defaultdict

BENIGN = {"benign", "normal"}
VAGUE = {"other", "unknown", "suspicious", "none"}


def features(packets, window=50):
    """Session and flow columns per packet."""
    sessions, flows, out = defaultdict(list), defaultdict(list), []
    for p in sorted(packets, key=lambda p: p["seq"]):
        where = (p["sensor_id"], p["session_id"])
        past = sessions[where]
        past.append((p["ts_us"], p["length"]))
        recent = past[-window:]
        span = recent[-1][0] - recent[0][0]
        who = (p["source_ip"], p["destination_ip"], p["protocol_number"] or p["protocol"])
        mine = flows[where + who]
        mine.append((p["ts_us"], p["length"]))
        sizes = [size for _, size in mine[-window:]]
        mean = sum(sizes) / len(sizes)
        name = hashlib.sha1("|".join(map(str, who)).encode()).hexdigest()[:8].upper()
        out.append({
            "seq": p["seq"], "flow_id": name,
            "time_diff": max(past[-1][0] - past[-2][0], 0) / 1e6 if len(past) > 1 else 0.0,
            "packet_rate": (len(recent) - 1) / (span / 1e6) if span > 0 else 0.0,
            "avg_length": sum(size for _, size in recent) / len(recent),
            "total_packets": len(mine), "total_bytes": sum(size for _, size in mine),
            "flow_duration": max(mine[-1][0] - mine[0][0], 1) / 1e6,
            "min_pkt_len": min(sizes), "max_pkt_len": max(sizes), "avg_pkt_len": mean,
            "pkt_len_std": math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)),
        })
    return out


def decide(rows, cfg):
    """(prediction, reason) per row; rows carry features, gates and scores."""
    votes, out = defaultdict(list), []
    for r in sorted(rows, key=lambda r: r["seq"]):
        ready = r["total_packets"] >= cfg.min_flow_packets and r["flow_duration"] >= cfg.min_flow_duration
        word, attack = r["det_prediction"].lower(), (r["det_attack_label"] or "").lower()
        if r["source_port"] is None and r["destination_port"] is None:
            got = ("Normal", "ip_fragment_skipped")
        elif not ready:
            got = ("Normal", "flow_warmup")
        elif r["total_packets"] % cfg.classify_interval:
            got = ("Normal", "flow_interval_skip")
        elif word in VAGUE or attack in VAGUE:
            got = (r["det_attack_label"] or r["det_prediction"], "model_uncertain_attack")
        elif word not in BENIGN and r["det_confidence"] < cfg.binary_threshold:
            got = ("Normal", "model_low_confidence")
        else:
            book = votes[(r["sensor_id"], r["session_id"], r["flow_id"])]
            book.append(word not in BENIGN)
            last = book[-cfg.vote_window:]
            lost = book[-1] and sum(last) / len(last) < cfg.vote_ratio
            got = ("Normal", "model_low_confidence") if lost else (r["det_prediction"], "model_prediction")
        out.append((r["seq"], *got))
    return out


def respond(rows, blocked=(), warnings=None, commands=(), limit=3):
    """Action and note per row, the block set and the warnings at the end."""
    listed, warned, out = set(blocked), dict(warnings or {}), []
    todo = sorted(commands, key=lambda c: c["at_seq"])

    def obey(until):
        while todo and todo[0]["at_seq"] <= until:
            c = todo.pop(0)
            who = (c["sensor_id"], c["ip"])
            if c["op"] == "block":
                listed.add(who)
                warned.pop(who, None)
            else:
                listed.discard(who)

    for r in sorted(rows, key=lambda r: r["seq"]):
        obey(r["seq"])
        src, dst = (r["sensor_id"], r["source_ip"]), (r["sensor_id"], r["destination_ip"])
        label = (r["attack_label"] or r["prediction"]).lower()
        if src in listed or dst in listed:
            got = ("blocked", "Matched existing blocklist rule")
        elif r["reason"] == "model_uncertain_attack":
            got = ("warning", "ML warning: uncertain class, review before treating as attack")
        elif r["prediction"].lower() in BENIGN or r["severity"] == "info":
            got = ("allow", None)
        elif r["source_ip"] and any(k in label for k in ("dos", "brute")):
            listed.add(src)
            warned.pop(src, None)
            got = ("blocked", f"Auto-blocked {r['prediction']} traffic")
        elif r["source_ip"] and any(k in label for k in ("recon", "scan")):
            n = warned.get(src, 0) + 1
            if n >= limit:
                listed.add(src)
                warned.pop(src, None)
                got = ("blocked", f"Auto-blocked after {limit} reconnaissance warnings")
            else:
                warned[src] = n
                got = ("warning", f"Recon warning {n}/{limit}")
        else:
            got = ("alert", None)
        out.append((r["seq"], *got))
    obey(math.inf)
    return out, listed, warned
