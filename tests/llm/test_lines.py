import hashlib
import inspect
import random
from collections import defaultdict

import duckdb
import pandas as pd

from quarryline.llm import lines


def brute(rows, ratio=lines.RATIO, least=lines.MIN_PAGES):
    pages, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        if text is not None and host is not None:
            hosts[host].add(text)
            for x in text.split("\n"):
                if x.strip(" \t\r\f\x0b"):
                    pages[host, x].add(text)
    gone = {k for k, v in pages.items() if len(v) >= least and len(v) > ratio * len(hosts[k[0]])}
    out = []
    for d, text, host in rows:
        split = [] if text is None else text.split("\n")
        kept = [x for x in split if (host, x) not in gone]
        out.append((d, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    rows = [(1, None, "a"), (2, "", "a"), (3, "home", None), (None, "home\nx", "a"), (4, " \n\t\n", "b")]
    for i in range(300):
        host = rng.choice(["a", "a", "b", "c"])
        text = [f"fresh {i}é", "", "home" if rng.random() < 0.4 else "near", f"rare {i % 60}", "  "]
        rng.shuffle(text)
        rows.append((10 + i, "\n".join(text * rng.choice([1, 1, 2])), host))
    rows += [(900 + i, "one page\nits copy", "b") for i in range(50)] + rows[20:30]
    return rows


def test_matches_brute_force_and_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, host int")
    want = brute(rows)
    assert sorted(map(tuple, lines.line_report(docs).collect()), key=str) == want
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert sorted(duckdb.sql(lines.SQL).fetchall(), key=str) == want


def test_texts_and_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, drop int")
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), digest(r.text)) for r in kept.collect()) == sorted((str(d), s) for d, _, _, s in brute(rows))
    assert any(r.text is None for r in kept.collect())
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_native():
    assert "udf" not in inspect.getsource(lines) and "Arrow" not in inspect.getsource(lines)
