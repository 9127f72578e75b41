import re

import __spark_entry__ as entry
from skein.vocab import NEGATIONS

TEXTS = [
    "We should use it", "you shouldn't", "don’t use it, avoid “that”", "café will do — not going to", "éuse it", "useé it", "should not", "ſhould not uſe", "WİLL", "usé it", "使use",
    "will_not", "do not use", "–does–", "doesn't über", "plain", "", "use٣", "еuse", "\U0001d400use", "USING\nit", "won't…",
]


def test_flags_of_all_scripts_equal_brute_force(spark, rows, tmp_path):
    data = [(str(i), t) for i, t in enumerate(TEXTS)] + [("none", None), ("0", TEXTS[0])]
    spark.createDataFrame(data, "id STRING, content STRING").write.parquet(f"{tmp_path}/messages.parquet")
    want = sorted({(i, *(bool(re.search(p, t, re.IGNORECASE)) for pair in NEGATIONS for p in pair)) for i, t in data if t is not None}, key=repr)
    assert rows(entry.queries()["negation_flags"](spark, str(tmp_path))) == want
