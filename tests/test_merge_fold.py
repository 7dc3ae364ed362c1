"""The merge in candidate order: worked cases, order-dependent ones, and the plan over sets where the order decides nothing."""

import random

import pytest
from pyspark.sql import functions as F

from mixframe.operators import merge
from mixframe.operators.merge_fold import Fold, Line, merge_in_order
from mixframe.sources import tracklists


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "tl_id bigint, text string")
    return tracklists.scan_tracklists(df).withColumnRenamed("tl_id", "pair_id").withColumn("dur", F.lit(None).cast("int"))


def written(df):
    out = tracklists.write_tracklists(df.withColumnRenamed("pair_id", "tl_id"))
    return {r.tl_id: r.text for r in out.collect()}


# Worked cases: original, candidate, merged.  The cue of a row only the editor's formatter fills is '??' here.
GAPS = ("""[000] Drexciya - Quantum Hydrodynamics [Tresor]
...
[040] Dold - Untitled 29 [Unterwegs]
...""", """[000] ?
...
[010] Rubberneck - Pot [Konsequent]
...
[022] Surgeon - Patience, Pt.3 [Dynamic Tension]
[027] Steve Bicknell - How Can We Know? Track 3 [S-B-Productions]
...
[037] Robert Hood - One Touch [M-Plant]
[040] Dold - Untitled 29 [Unterwegs]
[043] ?
...
[072] Jeroen Search - IC [Basic Beat]
...""", """[000] Drexciya - Quantum Hydrodynamics [Tresor]
...
[010] Rubberneck - Pot [Konsequent]
...
[022] Surgeon - Patience, Pt.3 [Dynamic Tension]
[027] Steve Bicknell - How Can We Know? Track 3 [S-B-Productions]
...
[037] Robert Hood - One Touch [M-Plant]
[040] Dold - Untitled 29 [Unterwegs]
[043] ?
...
[072] Jeroen Search - IC [Basic Beat]
...""")
BARE = ("""# Delta Vaults - Colors Of Life (Extended Mix)
# Röyksopp - Running To The Sea (Anamē Remix)
# Lexer - The Edge Of Everything (Extended Mix)
# Bar Shaked, Mai Yani - Take It All Out (Avoure Remix)
# Paul Conrad - Moonlit (Extended Mix)
# Dorothy - Take My Hand (Extended Mix)
# MaXure - Better Than This (Extended Mix)""", """[02] Delta Vaults - Colors Of Life [Purified]
[05] Röyksopp - Running To The Sea [Dog Triumph]
[11] ?
...
[16] Bar Shaked - Take It All Out [Magnetic Magazine]
[29] Paul Conrad - Moonlit
[34] ?
...
[38] MaXure - Better Than This [Enormous Vision]""", """[02] Delta Vaults - Colors Of Life (Extended Mix) [Purified]
[05] Röyksopp - Running To The Sea (Anamē Remix) [Dog Triumph]
[11] Lexer - The Edge Of Everything (Extended Mix)
[16] Bar Shaked, Mai Yani - Take It All Out (Avoure Remix) [Magnetic Magazine]
[29] Paul Conrad - Moonlit (Extended Mix)
[34] Dorothy - Take My Hand (Extended Mix)
[38] MaXure - Better Than This (Extended Mix) [Enormous Vision]""")
SOME_CUES = ("""# [07] Neel - Riflesso [Spazio Disponibile]
# [??] Yrsen & Gannein - 01 [Unreleased]
# [13] DJ Dextro - Eon [Suara]
# [22] Havik - Mutation [Syncopated]
# [26] Jeremy P Caulfield - Night Hammer [Self Released]
# [45] ANNĒ - Floating Waves [Mutual Rytm]
# [??] Umek aka Polyvinyl - Endgame In Mind (Chlär Remix) [Suara]
# [58] Linear System - Bottom Left""", """[07] Neel - Riflesso [Spazio Disponibile]
...
[13] DJ Dextro - Eon
[22] Havik - Mutation
[26] Jeremy P Caulfield - Night Hammer [Dumb Unit]
[45] ANNĒ - Floating Waves [Mutual Rytm]
[49] Polyvinyl - Endgame In Mind (Chlär Remix) [Suara]
...
[58] Linear System - Bottom Left [Room Trax]""", """[07] Neel - Riflesso [Spazio Disponibile]
[??] Yrsen & Gannein - 01 [Unreleased]
[13] DJ Dextro - Eon [Suara]
[22] Havik - Mutation [Syncopated]
[26] Jeremy P Caulfield - Night Hammer [Self Released]
[45] ANNĒ - Floating Waves [Mutual Rytm]
[49] Umek aka Polyvinyl - Endgame In Mind (Chlär Remix) [Suara]
[58] Linear System - Bottom Left [Room Trax]""")
COLONS = ("""# [00:00] Deep Woods Intro
# [01:04] Tim Engelhardt - Love Triangle
# [06:33] TH;EN, Jonas Saalbach - Around Us
# [16:59] ZAC - Paradox
# [26:50] Victor Garde - Regression
# [40:55] Einmusik, Lexer - Crush (Extended)""", """[00] ?
...
[03] Tim Engelhardt - Love Triangle [Habitat]
[06] ?
...
[10] TH;EN & Jonas Saalbach - Around Us
[18] ZAC & Gaitha - PARADOX [ERRORR]
[27] Victor Garde - Regression (Extended Mix) [DEEP WOODS]
[43] Einmusik & Lexer - Crush""", """[00:00] Deep Woods Intro
[01:04] Tim Engelhardt - Love Triangle [Habitat]
[06:33] TH;EN, Jonas Saalbach - Around Us
[16:59] ZAC - Paradox [ERRORR]
[26:50] Victor Garde - Regression [DEEP WOODS]
[40:55] Einmusik, Lexer - Crush (Extended)""")


def test_worked_cases(spark):
    cases = [GAPS, BARE, SOME_CUES, COLONS]
    out = written(merge_in_order(parsed(spark, *[c[0] for c in cases]), parsed(spark, *[c[1] for c in cases])))
    for k, case in enumerate(cases, 1):
        assert out[k] == case[2], k


def fold(orig, cand):
    """Short lists: 'text' or 'cue text' or 'cue text>position matched', '...' for a gap."""
    def line(s):
        if s == "...":
            return Line("gap")
        s, _, hit = s.partition(">")
        cue, _, text = s.rpartition(" ")
        return Line("track", cue or None, text, hit=int(hit) if hit else None)
    return ["..." if x.type == "gap" else f"{x.cue or ''} {x.text}".strip() for x in Fold([line(x) for x in orig], [line(x) for x in cand]).run()]


def test_two_candidates_on_one_original():
    # the first one's cue stays, the later one is the anchor: y stands behind it and takes the slot, x is placed by its cue
    assert fold(["a", "?", "05 b"], ["01 a>0", "02 x", "03 a>0", "04 y"]) == ["01 a", "02 x", "04 y", "05 b"]
    # an open cue takes the next better one
    assert fold(["0? a"], ["0? a>0", "07 a>0", "08 a>0"]) == ["07 a"]


def test_crossing_matches():
    # c and a are swapped in the candidate: x would stand behind c and before a, where nothing is; y takes the first slot behind a
    assert fold(["01 a", "?", "03 c", "?"], ["03 c>2", "02 x", "01 a>0", "04 y"]) == ["01 a", "02 x", "04 y", "03 c", "?"]


def test_unknowns():
    assert fold(["01 a", "02 ?"], ["02 x"]) == ["01 a", "02 x"]  # same cue
    assert fold(["01 a", "b", "c"], ["01 a>0", "05 ?"]) == ["01 a", "05 b", "c"]  # gives its cue to the next line
    assert fold(["01 a", "?"], ["...", "01 a>0"]) == ["01 a", "?"]  # a gap uses the first slot, but none is before a
    assert fold(["?", "09 b"], ["...", "05 x", "09 b>1"]) == ["?", "...", "05 x", "09 b"]  # a gap uses the slot up
    assert fold(["01 a"], ["02 ?"]) == ["01 a"] and fold(["01 a", "..."], ["02 ?"]) == ["01 a", "02 ?", "..."]
    assert fold([], ["01 a"]) == ["01 a"] and fold(["01 a"], []) == ["01 a"] and fold([], []) == []


def test_odd_pairs(spark):
    orig, cand = parsed(spark, "A - One", "B - Two", "..."), parsed(spark, "[01] A - One [L]")
    cand = cand.unionByName(parsed(spark, "x", "x", "x", "[02] C - New").where("pair_id = 4"))
    cand = cand.unionByName(cand.where("pair_id = 1").withColumn("pair_id", F.lit(None).cast("bigint")))
    out = written(merge_in_order(orig.withColumn("note", F.lit(1)), cand))
    assert out == {1: "[01] A - One [L]", 2: "[??] B - Two", 3: "...", 4: "[02] C - New"}
    assert merge_in_order(orig.limit(0), cand.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_set_plan_agrees_without_conflicts(spark, seed):
    rng = random.Random(seed)
    origs, cands = [], []
    for _ in range(6):
        n = rng.randint(4, 9)
        names = [f"Act{rng.randint(100, 999)} - Tune{rng.randint(1000, 9999)}{i}" for i in range(n)]
        origs.append("\n".join(f"[{5 * i:02d}] {x}" for i, x in enumerate(names)))
        cands.append("\n".join(f"[{5 * i + 2:02d}] {'New' + str(i) * 8 + ' - Track' if rng.random() < 0.4 else x + ' [Lab]'}" for i, x in enumerate(names)))
    orig, cand = parsed(spark, *origs), parsed(spark, *cands)
    assert written(merge_in_order(orig, cand)) == written(merge.merge_tracklists(orig, cand))
