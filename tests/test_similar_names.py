import difflib
import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import similar_names
from claimweave.functions import text


def pairs(spark, wanted, names, **how):
    frame = similar_names.close_names(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame([(n,) for n in names], "name string"), **how)
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.wanted, r.place)):
        out.setdefault(r.wanted, []).append(r.name)
    return out


def plain(wanted, names, n=5, cutoff=0.82):
    keys = sorted({x for x in names if x})
    close = {w: difflib.get_close_matches(w, keys, n=n, cutoff=cutoff) for w in set(wanted) if w}
    return {w: c for w, c in close.items() if c}


@pytest.mark.parametrize("letters, longest", [("AB", 8), ("ABC", 12), ("ABCDEFGH ", 30)])
def test_same_as_all_pairs_on_random_names(spark, letters, longest):
    """Few letters and short names: many repeats and ratios right at the cutoff."""
    rng = random.Random(longest)
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(250)]
    wanted = []
    for n in names[:150]:
        at, edit = rng.randrange(len(n)), rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
        wanted.append(n[:at] + edit + n[at + 1 :])
        wanted.append(n[:at] + n[at:][::-1])
    assert pairs(spark, wanted, names) == plain(wanted, names)


def test_cutoffs_and_places(spark):
    names = ["CONSTELLATION BRANDS", "CONSTELLATION BRAND", "CONSTELATION BRANDS", "CONSTELLATION BRANDSX", "CONSTELLATION BRNDS", "CONSTELLATION BRADS", "OTHER"]
    for cutoff in (0.82, 0.9, 0.97, 1.0):
        assert pairs(spark, ["CONSTELLATION BRANDS", "A"], names, cutoff=cutoff, best=3) == plain(["CONSTELLATION BRANDS", "A"], names, 3, cutoff)
    with pytest.raises(ValueError, match="below"):
        pairs(spark, ["A"], ["A"], cutoff=0.7)


def test_odd_names(spark):
    odd = ["", None, "A", "A", "AB", "ABC", "AAAAAAAA", "AAAAAAA", "X" * 300, "X" * 290 + "Y"]
    assert pairs(spark, odd, odd) == plain(odd, odd)
    assert pairs(spark, [], odd) == pairs(spark, odd, []) == {}


def test_names_of_the_tables(spark):
    """All names of parts and nations together, with a letter doubled, against all pairs."""
    sf = "/root/testdata/sf0.001"
    named = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().crossJoin(spark.read.parquet(f"{sf}/nation.parquet").select("n_name"))
    names = [r[0] for r in named.select(text.norm(F.concat_ws(" ", "p_name", "n_name"))).collect()][:500]
    wanted = [n[:4] + n[4] + n[4:] for n in names[::9]]
    assert pairs(spark, wanted, names) == plain(wanted, names)


@pytest.mark.parametrize("sent", [0, similar_names.SENT])
def test_names_meet_once_whether_sent_or_not(spark, monkeypatch, sent):
    monkeypatch.setattr(similar_names, "SENT", sent)
    names = [f"{a} {b} {c}" for a in ("LARGE", "LARGER", "SMALL") for b in ("RING", "RINGS", "BOLT") for c in ("NORTH", "SOUTH")]
    wanted = [n[:3] + n[4:] for n in names] + names[:3]
    assert pairs(spark, wanted, names) == plain(wanted, names)
