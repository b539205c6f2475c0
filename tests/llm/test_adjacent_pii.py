"""Personal data of each pair of kinds side by side: all of it goes, and each value has the pseudonym it has alone."""

VALUES = {
    "phone": "+1 (826) 555-4081",
    "abroad": "+44 20 7946 0958",
    "local": "415-555-2671",
    "ipv4": "190.137.223.204",
    "card": "4111 1111 1111 1111",
    "run": "4111111111111111",
    "amex": "3782 822463 10005",
    "iban": "DE89 3704 0044 0532 0130 00",
    "date": "1984-02-29",
    "ssn": "536-22-1234",
    "email": "jo.smith@x.org",
}
BESIDE = {"4111 1111 1111 1111 12/27": "card", "4111111111111111 123": "run", "5 4111111111111111": "run", "4111 1111 1111 1111 123": "card"}


def test_adjacent_values(spark):
    from marlstone.llm.pseudonyms import pseudonymise

    texts = [(k, v) for k, v in VALUES.items()] + [(f"{a}|{b}", f"{VALUES[a]} {VALUES[b]}") for a in VALUES for b in VALUES] + [(t, t) for t in BESIDE]
    got = {r["doc_id"]: (r["text"], r["n_pii"]) for r in pseudonymise(spark.createDataFrame(texts, "doc_id string, text string").repartition(4)).collect()}
    assert all(got[k][0] != v and got[k][1] == 1 for k, v in VALUES.items())
    wrong = [(a, b, got[f"{a}|{b}"][0]) for a in VALUES for b in VALUES if got[f"{a}|{b}"][0] != f"{got[a][0]} {got[b][0]}"]
    assert wrong == []
    for t, k in BESIDE.items():
        assert got[t][0] == t.replace(VALUES[k], got[k][0])
