"""Schedules held to exact shares, and mixed tables beside the schedule in plain Python."""

import random
from fractions import Fraction

import pytest

from traitsieve.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_slot long, rid int"


def worst_lag(weights, steps):
    """Largest distance of a source from its exact share over the first slots."""
    whole = mixing.whole_weights(weights)
    total, done, worst = sum(whole.values()), dict.fromkeys(whole, 0), 0
    endless = dict.fromkeys(whole, 10**12)
    for slot, (s, block) in zip(range(1, steps + 1), mixing.schedule(endless, whole)):
        assert block == done[s]
        done[s] += 1
        worst = max(worst, *(abs(n - Fraction(whole[x] * slot, total)) for x, n in done.items()))
    return worst


def test_never_a_block_away_from_given_weights():
    assert worst_lag({"a": 5, "b": 3, "c": 1.7, "d": 0.3333, None: 0.0004}, 100_000) < 1


@pytest.mark.parametrize("seed", range(12))
def test_never_a_block_away_from_any_weights(seed):
    rng = random.Random(seed)
    weights = {s: rng.choice([1, 2, rng.random(), rng.random() ** 6 + 1e-9]) for s in range(rng.randint(1, 30))}
    assert worst_lag(weights, 3_000) < 1


def by_simulation(blocks, weights):
    """The same rule, every source looked at in every slot."""
    left = {s: n for s, n in blocks.items() if s in weights and n}
    start, out = dict.fromkeys(left, 0), []
    while left:
        total, done, now = sum(weights[s] for s in left), dict.fromkeys(left, 0), 0
        while all(done[s] < left[s] for s in left):
            able = [s for s in left if Fraction(done[s] * total, weights[s]) // 1 <= now]
            s = min(able, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), list(weights).index(s)))
            out.append((s, start[s] + done[s]))
            done[s] += 1
            now += 1
        for s in list(left):
            start[s] += done[s]
            left[s] -= done[s]
            if not left[s]:
                del left[s]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_schedule_is_earliest_deadline_first(seed):
    rng = random.Random(seed)
    weights = {s: rng.randint(1, 50) for s in range(rng.randint(1, 9))}
    blocks = {s: rng.randint(0, 40) for s in [*weights, "unnamed"]}
    assert list(mixing.schedule(blocks, weights)) == by_simulation(blocks, weights)


def made(n=400, seed=3):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None, "", "d"])
    rows = [(i, "x" * rng.randint(0, 90), source(), 7, i) for i in range(n)]
    rows += [rows[0], rows[0], (None, None, None, 0, 1), (None, "é" * 50, "b", 0, 1), (n, "long " * 4_000, "c", 0, 2)]
    rows += [(n + 1 + i, "", "hot", 0, 0) for i in range(60)]
    return rows


def mixed(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source", "rid").repartition(3), **options).collect()


def test_mixed_table_follows_the_schedule(spark):
    rows = made()
    out = mixed(spark, rows, block=100)
    key = lambda r: (r[0] if r[0] is not None else -1, r[1] or "")
    assert sorted(map(key, out)) == sorted(map(key, rows))
    lengths = {}
    for _, text, source, _, _ in rows:
        lengths[source] = lengths.get(source, 0) + len((text or "").encode())
    blocks = {s: max(1, -(-n // 100)) for s, n in lengths.items()}
    for s, n in lengths.items():
        own = sorted((r["mix_place"], r["mix_bytes"]) for r in out if r["source"] == s)
        ends = [p + b for p, b in own]
        assert own[0][0] == 0 and max(ends) == n and sorted(p for p, _ in own)[1:] == sorted(ends)[:-1]
    order = sorted(lengths, key=lambda s: (-lengths[s], s is not None, s))
    weights = {s: round(max(lengths[s], 1) ** 0.7 * mixing.PARTS) for s in order}
    slot = {owner: k for k, owner in enumerate(by_simulation(blocks, weights))}
    for r in out:
        assert r["mix_block"] == min(r["mix_place"] // 100, blocks[r["source"]] - 1)
        assert r["mix_slot"] == slot[(r["source"], r["mix_block"])]


def test_given_weights_and_sources_without_one(spark):
    rows = made()
    out = mixed(spark, rows, weights={"hot": 2, None: 0.7, "b": 0, "absent": 5}, block=100)
    assert len(out) == len(rows)
    named = [r["mix_slot"] for r in out if r["source"] in ("hot", None)]
    others = [r["mix_slot"] for r in out if r["source"] not in ("hot", None)]
    assert max(named) < min(others)
    owners = {}
    for r in out:
        group = r["source"] if r["source"] in ("hot", None) else "others"
        assert owners.setdefault(r["mix_slot"], (group, r["mix_block"])) == (group, r["mix_block"])


def test_sources_beyond_the_listed_share_a_group(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES_MOST", 3)
    rows = made() + [(10_000 + i, "y" * (i % 40), f"host{i}", 0, 0) for i in range(300)]
    out = mixed(spark, rows, block=100)
    assert len(out) == len(rows)
    hosts = [r for r in out if (r["source"] or "").startswith("host")]
    assert len({r["mix_place"] for r in hosts if r["mix_bytes"]}) == sum(1 for r in hosts if r["mix_bytes"])
    slots = sorted(r["mix_slot"] for r in out)
    assert min(r["mix_slot"] for r in hosts) < slots[len(slots) // 2]


def test_blocks_grow_so_that_the_schedule_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    monkeypatch.setattr(mixing, "SLOTS_MOST", 50)
    out = mixed(spark, made())
    assert max(r["mix_slot"] for r in out) < 50 + 7 and len({r["mix_slot"] for r in out}) > 20


def test_order_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    whole = mixing.mixed_order(docs)
    assert whole.columns == docs.columns and whole.count() == docs.count()
    assert mixing.mixed_order(docs.where("false")).count() == 0
    only = docs.where("text is null or text = ''")
    assert mixing.mixed_order(only).count() == only.count()
