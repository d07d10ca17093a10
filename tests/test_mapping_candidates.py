"""The sequence ratio against difflib, and decisions over candidates against decisions over all pairs."""

import difflib
import random

import pytest

from sparkgauge.functions.ratio import ratios
from sparkgauge.operators import mapping as M


def names(seed, n):
    r = random.Random(seed)
    parts = ["cust", "customer", "id", "email", "addr", "address", "first", "name", "phone", "nr", "zip", "code", "price", "amount", "created", "at", "x", "e-mail", "date", "of", "birth"]
    out = {"_".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n)}
    out |= {"".join(r.choices("abcdef_", k=r.randint(1, 9))) for _ in range(n // 3)} | {"", "_", "Email", "PhoneNumber", "ZIP", "é"}
    return sorted(out)


def test_ratio_is_that_of_difflib():
    r = random.Random(3)
    a = ["".join(r.choices("abcd_é😀", k=r.randrange(20))) for _ in range(3000)] + ["", "x", "", "abc" * 70]
    b = ["".join(r.choices("abcd_é😀", k=r.randrange(20))) for _ in range(3000)] + ["", "", "y", "cab" * 60]
    want = [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)]
    assert ratios(a, b).tolist() == want and ratios([], []).tolist() == []


@pytest.mark.parametrize("threshold, epsilon, force", [(0.6, 0.3, False), (0.72, 0.03, True)])
def test_decisions_of_candidates_are_those_of_all_pairs(spark, threshold, epsilon, force):
    columns, refs = names(1, 40), names(2, 30)
    r = random.Random(4)
    rows = [(i, n, r.random() < 0.3, r.choice([None, None, "Email", "Phone", "Date"])) for i, n in enumerate(columns)]
    sources = spark.createDataFrame(rows, "place int, source string, numeric boolean, detected string")
    table = M.reference_names(spark, refs, M.merged_synonyms({"email": ["cust"]}))
    plain = M.decisions(M.scores(sources, table), sources, threshold, epsilon, force)
    quick = M.decided(sources, table, threshold, epsilon, force, all_pairs=0)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(quick) == key(plain)
    least = threshold - (0 if force else epsilon)
    if least > 0.02:
        found = {(p.place, p.ref_place) for p in M.candidates(sources, table, least).collect()}
        need = {(p.place, p.ref_place) for p in M.scores(sources, table).where(f"final >= {least}").select("place", "ref_place").collect()}
        assert need <= found and (least < 0.5 or len(found) < 0.6 * len(columns) * len(refs))


def test_no_names_and_low_thresholds(spark):
    sources, none = M.names_only(spark, ["a", "b"]), M.reference_names(spark, [])
    assert {r.status for r in M.decided(sources, none, all_pairs=0).collect()} == {"unmapped"}
    assert M.decided(M.names_only(spark, []), M.reference_names(spark, ["a"]), all_pairs=0).collect() == []
    refs = M.reference_names(spark, ["a", "bc"])
    assert sorted(map(repr, M.decided(sources, refs, 0.02, 0.01, all_pairs=0).collect())) == sorted(map(repr, M.decided(sources, refs, 0.02, 0.01).collect()))
    with pytest.raises(ValueError):
        M.candidates(sources, refs, 0.0)
