"""The filters of the near-duplicate stage lose no pair that reaches the threshold."""

import random

import numpy as np
import pyarrow as pa

from marlstone.llm import near_copies as N


def sets_of(rng, count):
    out = [np.zeros(0, np.int64), np.array([7], np.int64)]
    while len(out) < count:
        base = {rng.getrandbits(62) for _ in range(rng.choice([3, 9, 40, 300, 1500]))}
        for changed in (0.0, 0.03, 0.08, 0.1, 0.12, 0.2, 0.4):
            keep = {h for h in base if rng.random() >= changed / 2}
            keep |= {rng.getrandbits(62) for _ in range(int(len(base) * rng.choice([0, changed / 2])))}
            out.append(np.array(sorted(keep), np.int64))
    return out


def test_long_bitmaps_keep_all_pairs_at_the_threshold():
    sets = sets_of(random.Random(3), 80)
    maps = [N.long_bitmap(s).tobytes() for s in sets]
    linked = dropped = 0
    for i, a in enumerate(sets):
        for j in range(i):
            near, left = N.similar(sets[j], a), N.close(maps[j], len(sets[j]), maps[i], len(a))
            assert left or not near
            linked, dropped = linked + near, dropped + (not left)
    assert linked > 50 and dropped > 1000
    assert {len(m) for m in maps} == {64, 128, 512}


def test_places_in_lists_keep_all_pairs_at_the_threshold():
    sets = [s for s in sets_of(random.Random(4), 80) if len(s)]
    rows = sorted((int(h), (len(s) << N.PLACE) + k, i) for i, s in enumerate(sets) for k, h in enumerate(s[: N.prefix_length(len(s))]))
    table = pa.table({"token": [r[0] for r in rows], "spot": [r[1] for r in rows], "id": [r[2] for r in rows]})
    kept = pa.Table.from_batches(list(N._shared(table.to_batches(max_chunksize=97))), schema=table.schema)
    assert 0 < kept.num_rows < table.num_rows
    bits = pa.array([N.bitmap(sets[i]).tobytes() for i in kept.column("id").to_pylist()], pa.binary())
    entries = kept.append_column("bits", bits).append_column("root", kept.column("id"))
    found = set()
    for batch in N._other_pairs(entries.to_batches(max_chunksize=97)):
        found |= set(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
    want = {(j, i) for i in range(len(sets)) for j in range(i) if N.similar(sets[j], sets[i])}
    assert len(want) > 50 and want <= found
    first = set()
    for batch in N._first_pairs(entries.to_batches(max_chunksize=97)):
        first |= set(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
    assert first and first <= found


def test_pairs_that_met_before_are_left_out_and_none_is_lost():
    rng = random.Random(6)
    base = sorted(rng.getrandbits(62) for _ in range(600))
    sets = [np.array(sorted({h for h in base if rng.random() < 0.93} | {rng.getrandbits(62) for _ in range(30)}), np.int64) for _ in range(12)]
    rows = sorted((i, (len(s) << N.PLACE) + k, int(h)) for i, s in enumerate(sets) for k, h in enumerate(s[: N.prefix_length(len(s))]))
    table = pa.table({"token": [r[2] for r in rows], "id": [r[0] for r in rows], "spot": [r[1] for r in rows]})
    entries = pa.Table.from_batches(list(N._with_prior(table.to_batches(max_chunksize=97))))
    assert entries.num_rows == len(rows)
    before = np.frombuffer(b"".join(entries.column("prior").to_pylist()), np.int64).reshape(-1, N.PRIOR)
    for k, (i, _, _) in enumerate(rows):
        own = [r[2] for r in rows[max(0, k - N.PRIOR) : k] if r[0] == i][::-1]
        assert before[k].tolist() == own + [0] * (N.PRIOR - len(own))
    entries = entries.append_column("bits", pa.array([N.bitmap(sets[r[0]]).tobytes() for r in rows], pa.binary())).append_column("root", entries.column("id"))
    entries = entries.sort_by([("token", "ascending"), ("spot", "ascending"), ("id", "ascending")])
    made = lambda t: [p for b in N._other_pairs(t.to_batches(max_chunksize=97)) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    every, new = made(entries.drop_columns(["prior"])), made(entries)
    assert set(new) == set(every) and len(set(every)) > 20
    assert len(every) > 10 * len(set(every)) and len(new) < 2 * len(set(every))
