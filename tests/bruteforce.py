"""Sequential, single-process restatements of the operator semantics.

Used only by tests on small fixtures: they replay events one at a time, the
way the semantics are defined, so the Spark plans can be compared with them.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def replay_order(events):
    """events: iterable of dicts with user_id,item_id,rating,ts,event_id."""
    return sorted(events, key=lambda e: (e["ts"], e["event_id"]))


def split_last(events, n_test):
    ev = replay_order(events)
    cut = len(ev) - n_test
    return ev[:cut], ev[cut:]


def blocks_sequential(train, gap):
    """Closed blocks per user: list of (user, [(item, ts), ...])."""
    open_blocks: dict = {}
    closed = []
    for e in replay_order(train):
        u = e["user_id"]
        blk = open_blocks.setdefault(u, [])
        if len(blk) > 1 and e["ts"] - blk[-1][1] > gap:
            closed.append((u, list(blk)))
            blk.clear()
        blk.append((e["item_id"], e["ts"]))
    return closed


def block_scores(closed):
    """Net effect per unordered pair of events with different items in a block:
    the earlier item gains 2 * (1 + 1/d) towards the later one, equal times
    give 1 + 1/d in both directions; d is the distance of first places of the
    two (item, ts) elements."""
    score = defaultdict(float)
    for _, blk in closed:
        place = {}
        for k in range(len(blk) - 1, -1, -1):
            place[blk[k]] = k  # ends at the first occurrence
        n = len(blk)
        for p in range(n):
            for q in range(p + 1, n):
                (ia, ta), (ib, tb) = blk[p], blk[q]
                if ia == ib:
                    continue
                w = 1.0 + 1.0 / abs(place[blk[p]] - place[blk[q]])
                if ta == tb:
                    score[(ia, ib)] += w
                    score[(ib, ia)] += w
                elif ta < tb:
                    score[(ia, ib)] += 2 * w
                else:
                    score[(ib, ia)] += 2 * w
    return {k: round(v, 6) for k, v in score.items()}


def topk(score, k):
    by_src = defaultdict(list)
    for (a, b), s in score.items():
        by_src[a].append((s, b))
    return {a: [b for s, b in sorted(lst, key=lambda t: (-t[0], t[1]))[:k]] for a, lst in by_src.items()}


def recommend_item_based(train, test, network, n):
    profile = defaultdict(list)
    for e in replay_order(train):
        profile[e["user_id"]].append(e["item_id"])
    recs = {}
    for u in {e["user_id"] for e in test}:
        if u not in profile:
            continue
        seen = set(profile[u])
        votes = Counter()
        for it in profile[u]:
            for nb in network.get(it, []):
                if nb not in seen:
                    votes[nb] += 1
        recs[u] = [i for i, _ in sorted(votes.items(), key=lambda t: (-t[1], t[0]))[:n]]
    return recs


def precision_recall(recs: dict, truth: dict, all_test_users):
    p = r = 0.0
    users = 0
    for u in all_test_users:
        rs = set(recs.get(u, []))
        if not rs:
            continue
        ts = truth.get(u, set())
        h = len(rs & ts)
        users += 1
        p += h / len(rs)
        r += h / len(ts)
    if users == 0:
        return None, None, 0
    return p / users, r / users, users


def _triples(items, delta):
    first = {}
    for i, it in enumerate(items):
        first.setdefault(it, i)
    out = set()
    its = list(first)
    for a in its:
        for b in its:
            if a < b and abs(first[a] - first[b]) < delta:
                out.add((a, b))
    return out


def seq_similarity(profiles, delta):
    """{(u, v): count} for u != v with a positive count."""
    tr = {u: _triples(p, delta) for u, p in profiles.items()}
    users = sorted(profiles)
    sim = {}
    for x, u in enumerate(users):
        for v in users[x + 1:]:
            c = len(tr[u] & tr[v])
            if c > 0:
                sim[(u, v)] = sim[(v, u)] = c
    return sim


def _top_lists(sim, users, k, pad):
    lists = defaultdict(list)
    for (u, v), s in sim.items():
        lists[u].append((s, v))
    if pad:
        for u in users:
            have = {v for _, v in lists[u]}
            for v in users:
                if v != u and v not in have:
                    lists[u].append((0, v))
    return {u: [v for s, v in sorted(l, key=lambda t: (-t[0], t[1]))[:k]] for u, l in lists.items() if l}


def user_based_sequential(events, n_test, delta, k, n, every, pad=True):
    ev = replay_order(events)
    t0 = len(ev) - n_test
    profiles = defaultdict(list)
    for e in ev[:t0]:
        profiles[e["user_id"]].append(e["item_id"])
    network = _top_lists(seq_similarity(profiles, delta), sorted(profiles), k, pad)
    per_event, recs, truth, cold = {}, defaultdict(set), defaultdict(set), 0
    test_users = set()
    for idx in range(t0, len(ev)):
        e = ev[idx]
        u = e["user_id"]
        test_users.add(u)
        if u in network:
            seen = set(profiles[u])
            votes = Counter()
            for v in network[u]:
                for it in profiles[v]:
                    if it not in seen:
                        votes[it] += 1
            top = [i for i, _ in sorted(votes.items(), key=lambda t: (-t[1], t[0]))[:n]]
            per_event[e["event_id"]] = top
            recs[u] |= set(top)
            truth[u].add(e["item_id"])
        else:
            cold += 1
        profiles[u].append(e["item_id"])
        if idx % every == 0:
            for uu, lst in _top_lists(seq_similarity(profiles, delta), sorted(profiles), k, False).items():
                network[uu] = lst
    return per_event, recs, truth, test_users, cold


def compat_versions(events, n_test, delta, every):
    """Versions of the user similarity under the reference's delta rule:
    at a refresh, a common pair {i, j} (i < j as strings, both within delta
    places in both profiles) is added when j first arrived for u or v since
    the previous refresh.  Returns {version: {(u, v): score}} with u < v."""
    ev = replay_order(events)
    t0 = len(ev) - n_test
    profiles, first_ord = defaultdict(list), defaultdict(dict)
    for k, e in enumerate(ev[:t0]):
        profiles[e["user_id"]].append(e["item_id"])
        first_ord[e["user_id"]].setdefault(e["item_id"], k)
    cur = {k: v for k, v in seq_similarity(profiles, delta).items() if k[0] < k[1]}
    out = {t0 - 1: dict(cur)}
    prev = t0 - 1
    for k in range(t0, len(ev)):
        e = ev[k]
        profiles[e["user_id"]].append(e["item_id"])
        first_ord[e["user_id"]].setdefault(e["item_id"], k)
        if k % every:
            continue
        place = {u: {} for u in profiles}
        for u, items in profiles.items():
            for pos, it in enumerate(items):
                place[u].setdefault(it, pos)
        users = sorted(profiles)
        for x, u in enumerate(users):
            for v in users[x + 1:]:
                common = sorted(set(profiles[u]) & set(profiles[v]), key=str)
                for a in range(len(common)):
                    for b in range(a + 1, len(common)):
                        i, j = common[a], common[b]
                        if abs(place[u][i] - place[u][j]) >= delta or abs(place[v][i] - place[v][j]) >= delta:
                            continue
                        if prev < first_ord[u][j] <= k or prev < first_ord[v][j] <= k:
                            cur[(u, v)] = cur.get((u, v), 0) + 1
        out[k] = dict(cur)
        prev = k
    return out
