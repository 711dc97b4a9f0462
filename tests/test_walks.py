"""Tree walks and graph searches against plain loops over small random data."""

import math
import random

from tidemark.operators import graph, tree


def plain_walk(seeds, nodes, leaves, top_k, depth, width, chars):
    queue, seen, order = [(n, 0) for _, n in sorted({n: r for r, n in sorted(seeds, reverse=True)}.items(), key=lambda x: (x[1], x[0]))] if False else [], set(), []
    ranks = {}
    for rank, n in seeds:
        ranks[n] = min(rank, ranks.get(n, rank))
    level = [n for n, _ in sorted(ranks.items(), key=lambda x: (x[1], x[0]))]
    placed = [(n, 0) for n in level]
    seen.update(level)
    for d in range(1, depth + 1):
        above = []
        for n in level:
            for p in nodes[n]["parents"] if n in nodes and not nodes[n]["secret"] else []:
                if p and p not in seen:
                    seen.add(p)
                    above.append(p)
        placed += [(p, d) for p in above]
        level = above
    summaries = []
    for b in range(0, min(len(placed), 6 * width), width):
        if len(summaries) >= top_k:
            break
        summaries += [(n, d) for n, d in placed[b : b + width] if n in nodes and not nodes[n]["secret"]]
    taken, parent_of, out, used = set(), {}, [], 0
    for place, (n, d) in enumerate(summaries, 1):
        kids = list(dict.fromkeys(c for c in nodes[n]["children"] if c))
        fresh = [c for c in kids if c not in taken][:width]
        cited = [c for c in kids if c in taken or c in fresh]
        taken.update(fresh)
        for c in cited:
            parent_of.setdefault(c, n)
        bad = any(c not in leaves or leaves[c][1] for c in cited)
        status = "excluded" if not kids else "review_required" if nodes[n]["reasons"] else "stale" if bad else "active"
        text = nodes[n]["text"][:chars] if status == "active" else ""
        used += len(text)
        out.append(("summary", n, None, status, d, place, text, used <= 16000 and place <= top_k))
    shown = sorted((p, c) for c, p in parent_of.items() if c in leaves and not leaves[c][1])
    for place, (p, c) in enumerate(shown, 1):
        used += len(leaves[c][0][:chars])
        out.append(("leaf", c, p, "safe", None, place, leaves[c][0][:chars], used <= 16000))
    return out


def test_tree_walk_random(spark):
    rng = random.Random(4)
    for width, top_k, depth in ((3, 4, 2), (8, 20, 3), (2, 5, 1)):
        leaves = {f"l{i}": ("x" * rng.randint(0, 1500), rng.random() < 0.05) for i in range(60)}
        nodes = {}
        for lv in (3, 2, 1):
            for i in range((2, 6, 20)[3 - lv]):
                below = [f"l{k}" for k in range(70)] if lv == 1 else [f"n{lv - 1}-{k}" for k in range(22)]
                up = [f"n{lv + 1}-{k}" for k in rng.sample(range(6), 2)] if lv < 3 else []
                nodes[f"n{lv}-{i}"] = {"level": lv, "children": rng.choices(below, k=rng.choice((0, 3, 6, 12))), "parents": up, "text": "t" * rng.randint(0, 3000), "secret": rng.random() < 0.1, "reasons": ["stale"] if rng.random() < 0.1 else []}
        leaves |= {n: (v["text"], v["secret"]) for n, v in nodes.items()}
        seeds = {w: [(rng.randint(0, 5), f"n1-{rng.randint(0, 24)}") for _ in range(rng.choice((1, 3, 9)))] for w in range(6)}
        got = tree.walk(
            spark.createDataFrame([(w, n, r) for w, rows in seeds.items() for r, n in rows], "walk int, node_id string, rank int"),
            spark.createDataFrame([(n, v["level"], v["children"], v["parents"], v["text"], v["secret"], v["reasons"]) for n, v in nodes.items()], "node_id string, level int, child_ids array<string>, parent_ids array<string>, text string, secret boolean, reasons array<string>"),
            spark.createDataFrame([(k, t, b, False) for k, (t, b) in leaves.items()], "id string, text string, unsafe boolean, secret boolean"), top_k=top_k, depth=depth, max_children=width,
        ).collect()
        found = {(r.walk, r.kind, r.id, r.parent, r.status, r.depth, r.place, r.text, r.kept) for r in got}
        assert found == {(w, *row) for w, rows in seeds.items() for row in plain_walk(rows, nodes, leaves, top_k, depth, width, 1200)}


def plain_search(seeds, edges, points, top_k, depth, cap, total, floor):
    w = graph.WEIGHTS
    start = sorted(seeds.items(), key=lambda x: (-x[1], x[0]))[:total]
    met, frontier, found = {i for i, _ in start}, [(i, 0, [i], []) for i, _ in start], []
    while frontier and len(found) < total:
        node, d, path, confs = frontier.pop(0)
        if d >= depth:
            continue
        near = sorted((side, e, o, c) for e, a, b, c, s in edges for side, x, o in ((0, a, b), (1, b, a)) if x == node and a != b and (c or 0.0) >= floor and s not in graph.INACTIVE)
        taken = 0
        for _, _, other, c in near:
            if taken >= cap or len(found) >= total:
                break
            if other in met:
                continue
            taken += 1
            found.append((other, d + 1, [*path, other], [*confs, c or 0.0]))
            if d + 1 < depth:
                met.add(other)
                frontier.append(found[-1])
    best = {i: (0, [i], [], v) for i, v in seeds.items()}
    for i, d, path, confs in found:
        best.setdefault(i, (d, path, confs, 0.0))
    rows = []
    for i, (d, path, confs, v) in best.items():
        use, status = points.get(i, (0.0, None))
        score = w["vector"] * v + (w["distance"] * math.exp(-d) if d else 0) + w["confidence"] * (sum(confs) / len(confs) if confs else 0) + w["usefulness"] * use - (w["stale"] if status in graph.INACTIVE else 0)
        if score > 0:
            rows.append((-round(score, 9), i, d, tuple(path)))
    return [(i, d, p, -s) for s, i, d, p in sorted(rows)[:top_k]]


def test_graph_search_random(spark):
    rng = random.Random(6)
    edges = [(f"e{k:03}", f"v{rng.randint(0, 40)}", f"v{rng.choice((0, 1, rng.randint(0, 40)))}", rng.choice((None, 0.2, 0.5, 0.9)), rng.choice((None, "active", "stale", "verified"))) for k in range(260)]
    points = {f"v{i}": (rng.choice((0.0, 0.5, 1.0)), rng.choice((None, "disputed", "active"))) for i in range(35)}
    seeds = {s: {f"v{rng.randint(0, 45)}": round(rng.random(), 3) for _ in range(rng.choice((1, 4)))} for s in range(8)}
    frames = (
        spark.createDataFrame([(s, i, v) for s, rows in seeds.items() for i, v in rows.items()], "seed int, id string, vector_score double"),
        spark.createDataFrame(edges, "edge_id string, src string, dst string, confidence double, status string"),
        spark.createDataFrame([(i, *v) for i, v in points.items()], "id string, usefulness double, status string"),
    )
    for depth, cap, total, floor in ((2, 3, 64, 0.0), (3, 8, 20, 0.3), (1, 2, 5, 0.0)):
        got = {}
        for r in sorted(graph.search(*frames, top_k=20, depth=depth, cap=cap, total=total, floor=floor).collect(), key=lambda r: r.place):
            got.setdefault(r.seed, []).append((r.id, r.distance, tuple(r.path), round(r.score, 9)))
        assert got == {s: rows for s, own in seeds.items() if (rows := plain_search(own, edges, points, 20, depth, cap, total, floor))}
