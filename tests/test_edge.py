import random
import re

import numpy as np
import pytest

from shopfloor.plans.edgework import post_edge_lineal

FILMS = {"ILPRT", "ILFAB", "ILNAT", "ILSGP"}


def plain_number(text):
    return float(text) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", text or "") else None


def expected(layers, gaps, attrs):
    """(value, written pre-and-post, error) from the stack itself: ``gaps`` are
    (count text, films, process, stop), ``layers`` the glass code's end."""
    edge = attrs.get("EW-STRAIGHT") or ""
    if not edge or not layers.isdigit():
        return None, None, False
    gaps = gaps[: max(int(layers) - 1, 0)]
    stop = next((k for k, g in enumerate(gaps) if g[3]), None)
    read = gaps if stop is None else gaps[: stop + 1]
    if any(not g[0][:1].isdigit() for g in read) or len(read) < int(layers) - 1 and stop is None:
        return None, None, True
    firsts = []
    for count, films, process, _ in gaps[:stop]:
        film = next((f for f in films[: int(count[0])] if f[0] in FILMS), None)
        if film:
            firsts.append((film[0], film[1] == "IMSCIPI" and process == "AN"))
    post = stop is not None or any(after for _, after in firsts)
    pre = any(not after for _, after in firsts)
    sgp = any(kind == "ILSGP" for kind, _ in firsts)
    wants = plain_number(attrs.get("ANNLAMI")) == 1 or "EFGPO" in edge
    whole = post or (wants and plain_number(attrs.get("CP-BUY-OUT-BEV-POST")) != 1 and not pre)
    tokens = [t for t in edge.split(",") if t and "EFPCN" not in t and "ESEAM" not in t]
    both = [t for t in tokens if "EFGPO" in t]
    counted = tokens if whole else both if sgp else []
    both = both if whole or sgp else []
    size = {t: plain_number(t.split("=")[1]) if "=" in t else None for t in counted}
    if None in size.values():
        return None, None, True
    total = lambda ts: sum((np.float32(size[t]) for t in ts), np.float32(0))
    value, written = total(counted), total(both)
    return (
        float(value) if value > 0 else None,
        float(written) if written > 0 and "CP-EDGE-PREandPOST" in attrs else None,
        False,
    )


def _frames(spark, items):
    attrs, codes, opts = [], [], []
    for item_id, (a, c, o) in items.items():
        attrs += [(item_id, k, v) for k, v in a.items()]
        codes += [(item_id, k, v) for k, v in c.items()]
        opts += [(item_id, opt, grp) for opt, grp in o]
    return (
        spark.createDataFrame(attrs, "item_id long, name string, value string"),
        spark.createDataFrame(codes, "item_id long, group_name string, code string"),
        spark.createDataFrame(opts or [(0, "X", "X")], "item_id long, option string, group_name string"),
    )


def _run(spark, items):
    out = post_edge_lineal(*_frames(spark, items)).collect()
    return {r["item_id"]: (r["AttributeValue"], r["PrePostWritten"], r["EdgeError"]) for r in out}


def _stack(gaps, lite="1", layers=None):
    """gaps: list of (count, [(type, code)], process, shatop)."""
    layers = len(gaps) + 1 if layers is None else layers
    codes = {f"LITE {lite} GLASS": f"LAM{layers}"}
    opts = set()
    for i, (count, films, proc, shatop) in enumerate(gaps, start=1):
        codes[f"LITE {lite}.{i} INTERLAYERS"] = f"{count}PLY"
        codes[f"LITE {lite}.{i} PROCESS"] = proc
        for j, (ftype, fcode) in enumerate(films, start=1):
            codes[f"LITE {lite}.{i} IL{j} TYPE"] = ftype
            codes[f"LITE {lite}.{i} IL{j}"] = fcode
        if shatop:
            opts.add(("SHATOP", f"LITE {lite}.{i} OPTION"))
    return codes, opts


EW = "EFGPO=10,EFPCN=5,ESEAM=2,EFP=4"


def test_fixture_rows(spark):
    base = {"EW-STRAIGHT": EW, "LITE": "1", "ANNLAMI": "1", "CP-EDGE-PREandPOST": "0"}
    no_film = _stack([(1, [("ILCLR", "X")], "HS", False)])
    items = {
        1: (base, *no_film),
        2: (base, *_stack([(1, [("ILPRT", "X")], "HS", False)])),
        3: (base, *_stack([(1, [("ILSGP", "X")], "HS", False)])),
        4: (base, *_stack([(1, [("ILPRT", "X")], "HS", False), (1, [], "HS", True)])),
        5: (base, *_stack([(1, [("ILPRT", "IMSCIPI")], "AN", False)])),
        6: ({**base, "ANNLAMI": "0", "EW-STRAIGHT": "EFP=4,EBEV=3"}, *no_film),
        7: ({**base, "CP-BUY-OUT-BEV-POST": "1"}, *no_film),
        8: ({**base, "EW-STRAIGHT": ""}, *no_film),
        9: (base, {"LITE 1 GLASS": "MONO"}, set()),
        10: ({**base, "EW-STRAIGHT": "EFGPO=10,EFP="}, *no_film),
        11: ({**base, "EW-STRAIGHT": "EFGPO=10,EFP"}, *no_film),
    }
    got = _run(spark, items)
    assert got[1] == (14.0, 10.0, False)
    assert got[2] == (None, None, False)  # film before lamination: pre
    assert got[3] == (10.0, 10.0, False)  # SGP film: EFGPO tokens only (E9)
    assert got[4] == (14.0, 10.0, False)  # SHATOP in gap 2 -> post wins (T22)
    assert got[5] == (14.0, 10.0, False)  # IMSCIPI + AN -> post
    assert got[6] == (None, None, False)
    assert got[7] == (None, None, False)
    assert got[8] == (None, None, False)
    assert got[9] == (None, None, False)
    assert got[10] == (None, None, True) and got[11] == (None, None, True)


@pytest.mark.parametrize("seed", [7, 8])
def test_equals_the_rules_on_random_stacks(spark, seed):
    rnd = random.Random(seed)
    tokens = ["EFGPO=5", "EFGPO=7", "EFP=3", "EFPCN=2", "ESEAM=1", "EBEV=4", "", "EFP", "EFGPO=x", "EFGPO-X=2", "EFP=5f", "EFP=NaN"]
    weights = [8, 8, 8, 4, 4, 8, 4, 1, 1, 4, 1, 1]
    types = ["ILPRT", "ILFAB", "ILNAT", "ILSGP", "ILCLR", "ILOTH"]
    items, want = {}, {}
    for item_id in range(400):
        lite = rnd.choice(["1", "2", "1 A", "A.B 2"])
        layers = rnd.choice(["0", "1", "2", "3", "4", "5", "X"])
        gaps = []
        for _ in range(max(int(layers) - 1, 0) if layers.isdigit() else 0):
            films = [(rnd.choice(types), rnd.choice(["IMSCIPI", "IMSTD"])) for _ in range(rnd.randint(0, 3))]
            count = "X" if rnd.random() < 0.05 else str(rnd.randint(0, 3))
            gaps.append((count, films, rnd.choice(["AN", "HS"]), rnd.random() < 0.2))
        codes, opts = _stack(gaps, lite=lite, layers=layers)
        attrs = {"EW-STRAIGHT": ",".join(rnd.choices(tokens, weights, k=rnd.randint(0, 5))), "LITE": lite}
        for name, choices in (("ANNLAMI", ["1", "0", "", "x", "1f"]), ("CP-BUY-OUT-BEV-POST", ["1", "0", ""])):
            if rnd.random() < 0.8:
                attrs[name] = rnd.choice(choices)
        if rnd.random() < 0.5:
            attrs["CP-EDGE-PREandPOST"] = "0"
        items[item_id] = (attrs, codes, opts)
        want[item_id] = expected(layers, gaps, attrs)
    got = _run(spark, items)
    for k in items:
        assert got[k] == want[k], (k, items[k])


def test_blank_in_the_lite_and_strict_numbers(spark):
    base = {"EW-STRAIGHT": "EFGPO=10,EFP=4", "CP-EDGE-PREandPOST": "3"}
    plain = [("1", [("ILCLR", "X")], "HS", False)]
    items = {
        1: ({**base, "LITE": "1"}, *_stack(plain)),
        2: ({**base, "LITE": "1 A"}, *_stack(plain, lite="1 A")),
        3: ({**base, "LITE": "1", "EW-STRAIGHT": "EFGPO=10,EFP=5f"}, *_stack(plain)),
        4: ({**base, "LITE": "1", "EW-STRAIGHT": "EFGPO=10,EFP=Infinity"}, *_stack(plain)),
        5: ({**base, "LITE": "1", "EW-STRAIGHT": ""}, *_stack(plain)),
    }
    got = _run(spark, items)
    assert got[1] == got[2] == (14.0, 10.0, False)
    assert got[3] == got[4] == (None, None, True)
    values = {r["item_id"]: r["PrePostValue"] for r in post_edge_lineal(*_frames(spark, items)).collect()}
    assert values == {1: "10.0", 2: "10.0", 3: "3", 4: "3", 5: "3"}
