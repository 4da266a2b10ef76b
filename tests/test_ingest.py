"""Entries that land again: versions, redo of broken ones, and calls that are cut into several."""

import json
import random

from residua.streaming import ingest


def brute(landings):
    """(entry, status, version) of landings in order."""
    kept, out = {}, []
    for entry, doc, _ in landings:
        last, version, broken = kept.get(entry, (None, 0, False))
        try:
            json.loads(doc)
        except (TypeError, ValueError):
            out.append((entry, "corrupt", version))
            kept[entry] = (last, version, True)
            continue
        status = ("redone" if broken else "new") if last is None else "same" if doc == last else "redone" if broken else "changed"
        version += status != "same"
        out.append((entry, status, version))
        kept[entry] = (doc, version, False)
    return out, {e: (v, d) for e, (d, v, _) in kept.items() if d is not None}


def test_entries_that_land_again(spark, tmp_path):
    rng = random.Random(5)
    docs = ['{"a": 1}', '{"a": 2}', '{"a": ', None, "", "[1, 2]"]
    landings = [(f"e{rng.randrange(40)}", rng.choice(docs), i) for i in range(300)]
    want, now = brute(landings)
    # in one call, and in five
    for name, cuts in (("one", [300]), ("five", [40, 41, 150, 299, 300])):
        at, begun = tmp_path / name, 0
        for cut in cuts:
            spark.createDataFrame(landings[begun:cut] + [(None, "{}", 0)], "entry string, doc string, reached long").write.mode("append").json(f"file://{at}/landed")
            begun = cut
            told = ingest.ingest_entries(spark, f"file://{at}/landed", f"file://{at}/table", f"file://{at}/checkpoint")
        rows = sorted((r["reached"], r["entry"], r["status"], r["version"]) for r in told.collect())
        assert [r[1:] for r in rows] == want, name
        assert {r["entry"]: (r["version"], r["doc"]) for r in ingest.current_entries(told).collect()} == now
    again = ingest.ingest_entries(spark, f"file://{tmp_path}/one/landed", f"file://{tmp_path}/one/table", f"file://{tmp_path}/one/checkpoint")
    assert again.count() == len(landings)
