"""Dictionary terms and patterns in texts against a plain search for each term."""

import random
import re

from pyspark.sql import functions as F

from marlstone.functions import entities as E

ODD = [
    None, "", "ria", "hr md ADMIN office", "Invoice No. INV-7 for Blue Planet Knitwear Ltd, USD 1,200.50 and USD 1,200.50; $3.50 per dozen",
    "straße Heat Press Machine, MHM machine 7; 12 machines, 16 head embroidery machine", "L.C. No 55/A work order no 9 Job No. 4 whatsapp GAZIPUR", "x" * 200000 + "Beximco", "Skin frame pallet Pre-heat pallet",
    "৳ 1,000.00 and 5,000 taka", "PO No A-1 po no a-1", "one bank one bank",
]


def rows(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD)], "id int, text string, kind string").repartition(3)


def test_each_term_is_found_as_by_itself(spark):
    rng = random.Random(2)
    words = {f"k{j}": ["".join(rng.choice("aBc") for _ in range(rng.randint(0, 4))) for _ in range(12)] for j in range(3)}
    texts = [None, *["".join(rng.choice("AbC ") for _ in range(rng.randint(0, 40))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, k, w) for i, t in enumerate(texts) for k, terms in words.items() for w in terms if t and w and w.upper() in t.upper())
    for part_bytes in (1 << 20, 7):
        index = E.TermIndex(words, part_bytes)
        assert (len(index.parts) > 5) == (part_bytes == 7)
        assert sorted(map(tuple, E.term_rows(df, index).collect())) == want
    assert E.term_rows(df, E.TermIndex({"none": [""]})).count() == 0
    assert E.term_rows(df.limit(0), E.TermIndex(words)).count() == 0


def test_short_entities(spark):
    got = {r["id"]: r for r in E.short_entities(rows(spark)).collect()}
    for k, t in enumerate(ODD):
        for kind, terms in E.SHORT.items():
            assert got[k][kind] == [x for x in terms if x.upper() in (t or "").upper()]
        found = [m for p in E.SHORT_AMOUNTS for m in re.findall(p, t or "", re.IGNORECASE)]
        assert got[k]["amounts"] == list(dict.fromkeys(found))
    assert got[3]["departments"] == ["HR", "Admin"] and got[0]["kind"] == "clash"


def test_wide_entities(spark):
    got = {r["id"]: r for r in E.wide_entities(rows(spark)).collect()}
    assert set(E.KEYS) <= set(got[0].asDict())
    for k, t in enumerate(ODD):
        t, r = t or "", got[k]
        once = lambda patterns, t=t: list(dict.fromkeys(m for p in patterns for m in re.findall(p, t, re.IGNORECASE)))
        held = lambda terms, t=t: [x for x in terms if x.upper() in t.upper()]
        assert r["customers"] == held(E.CUSTOMERS) and r["banks"] == held(E.BANKS) and r["suppliers"] == held(E.SUPPLIERS)
        assert r["materials"] == held(E.MATERIALS) and r["locations"] == held(E.LOCATIONS)
        assert r["machines_involved"] == list(dict.fromkeys(held(E.MACHINES) + once(E.MACHINE_WORDS)))
        assert r["departments_involved"] == [d for d, terms in E.STAFF.items() if held(terms)]
        assert r["currencies"] == r["amounts"] == once(E.CURRENCIES) and r["pricing_info"] == once(E.PRICES) and r["production_capacity"] == once(E.CAPACITIES)
        for key, patterns in E.NUMBERS.items():
            assert r[key] == once(patterns)
        assert r["regulatory_bodies"] == r["dates"] == r["certificates"] == []
        assert r["has_customer_data"] == bool(r["customers"]) and r["has_cross_departmental_refs"] == (len(r["departments_involved"]) > 1)
        assert r["entity_count"] == sum(len(r[c]) for c in ("customers", "staff_members", "machines_involved", "materials"))
    assert got[3]["departments_involved"] == ["hr_admin", "management"] and got[6]["has_remote_management_refs"] and got[6]["has_gazipur_location"] and got[5]["has_mhm_machine_refs"]
    assert E.wide_entities(rows(spark).filter("id < 0")).select(F.size("customers")).count() == 0


def test_given_texts_hold_terms(spark, sf_dir):
    kinds = {r["kind"] for r in E.QUERIES["jn12_terms"](spark, sf_dir).select("kind").distinct().collect()}
    assert len(kinds) >= 3
