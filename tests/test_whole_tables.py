"""Queries over every row, against brute force."""

import collections
import re
import unicodedata

from factlattice.functions import recalls
from factlattice.plans import catalogue


def test_forms_and_keys_of_every_row(spark, tmp_path):
    rows = [(1, "Élan", "２４ANB-7", "S"), (2, "Аir", "24–ANB 7", "s\u3000"), (3, " B ", "no digit", "T"), (4, None, "АВ12", "T"), (5, "B", None, "T"),
        (6, "B", "a1", "\u00a0"), (7, "B", "a①", "x")]
    spark.createDataFrame(rows, "catalog_id bigint, brand string, model string, series string").write.parquet(str(tmp_path / "acme_catalog.parquet"))

    def forms(m):
        if m is None:
            return None, None
        n = unicodedata.normalize("NFKC", m)
        d = re.sub("[^0-9]", "", n)
        return re.sub("[^0-9A-Za-z]", "", n).upper(), d.rjust(12, "0") if d else ""

    got = {r.catalog_id: (r.model_number, r.digits) for r in catalogue.QUERIES["identifier_forms"](spark, str(tmp_path)).collect()}
    assert got == {i: forms(m) for i, _, m, _ in rows} and got[1] == got[2] == ("24ANB7", "000000000247")
    keys = {r.catalog_id: r.record_key for r in catalogue.QUERIES["record_keys"](spark, str(tmp_path)).collect()}
    assert keys == {i: "|".join(x.strip() for x in p) if all(x and x.strip() for x in p) else f"catalog#{i}" for i, *p in rows}


def test_classes_of_every_text(spark, tmp_path):
    texts = ["Risk of FIRE; refund", "overheating", "electric shock and salmonella", None, "Gefahr", "fires"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", "eng", None, "en", "de", "en-US"], strict=True))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    words = [re.sub(r"[\W_]+", " ", f" {t.lower()} ") for t in texts if t]
    want = collections.Counter()
    for kind, rules in (("HAZARD", recalls.HAZARDS), ("REMEDY", recalls.REMEDIES), ("PATHOGEN", recalls.PATHOGENS)):
        want.update((kind, n) for t in words for n, terms in rules.items() if any((f" {x[:-1]}" if x[-1] == "*" else f" {x} ") in t for x in terms))
    got = {(r.kind, r["class"]): r.docs for r in catalogue.QUERIES["notice_classes"](spark, str(tmp_path)).collect()}
    assert got == dict(want) and got[("HAZARD", "fire")] == 2 and ("HAZARD", "electric-shock") in got
