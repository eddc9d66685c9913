"""Whole results against plain versions: digests of encoded texts, verdicts over random link graphs, the pipeline's last stages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, linkgraph, mixing, queries
from vellum.llm.common import Scratch

DIR = "/root/testdata/sf0.001"


def digests(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False).encode()
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def test_digests_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, DIR).collect()}
    assert got == {k: digests(t, library) for k, t in docs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_over_random_links(spark, seed):
    """Trust along links and distrust against them, by hosts: scores, what counts against a host, verdicts of all pages."""
    r = random.Random(seed)
    hosts = [f"h{k}.info" for k in range(12)] + ["a.net", "b.net", "example.com", "x.org", "y.org"]
    rows = []
    for k in range(120):
        to = r.sample([*hosts, "unseen.info"], r.randrange(4))
        rows.append((k, f"http://{r.choice(hosts)}/{r.choice(['', 'fr/', 'de/', 'x'])}", "".join(f'<a HREF = "//{t.upper()}/p">' for t in to)))
    rows += [(200, None, '<a href="http://h1.info/">'), (201, "http://h1.info/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in linkgraph.judge(df, Scratch(spark, "t")).collect()}
    host = {k: (u.split("://")[1].split("/")[0] if u else "") for k, u, _ in rows}
    by_rule = {k: got[k].rule and {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}[got[k].rule] for k in host}
    edges = Counter((host[k], t.lower()) for k, _, html in rows if html and host[k] for t in {x.split("/")[0] for x in html.split('"//')[1:]} if t.lower() != host[k])
    pages = Counter(h for h in host.values() if h)

    def spread(links, said):
        weight = Counter(host[k] for k, v in by_rule.items() if v == said and host[k])
        seed_of = {h: weight[h] / pages[h] for h in pages if weight[h]}
        total = sum(seed_of.values())
        start = {h: s / total for h, s in seed_of.items()}
        out = Counter()
        for (a, _), n in links.items():
            out[a] += n
        rank, arrived, going = {h: 0.15 * s for h, s in start.items()}, Counter(), start
        while sum(going.values()) > linkgraph.RESIDUAL:
            sent = Counter()
            for (a, b), n in links.items():
                sent[b] += 0.85 * going.get(a, 0) * n / out[a]
            for h, s in sent.items():
                rank[h] = rank.get(h, 0) + 0.15 * s
                arrived[h] += 0.15 * s
            going = sent
        limit = dict(start)
        for _ in range(300):
            into = Counter()
            for (a, b), n in links.items():
                into[b] += 0.85 * limit.get(a, 0) * n / out[a]
            limit = {h: into[h] + 0.15 * start.get(h, 0) for h in {*into, *start}}
        assert 0 <= sum(limit.values()) - sum(rank.values()) < linkgraph.RESIDUAL
        return rank, arrived

    n = len({*pages, *(b for _, b in edges)})
    (trust, _), (distrust, arrived) = spread(edges, "allow"), spread({(b, a): c for (a, b), c in edges.items()}, "block")
    blocked = Counter(host[k] for k, v in by_rule.items() if v == "block")
    for k, h in host.items():
        x = got[k]
        assert (x.trust, x.distrust) == pytest.approx((trust.get(h, 0) * n if h else 0, distrust.get(h, 0) * n if h else 0))
        against = (distrust if 2 * blocked[h] > pages[h] else arrived).get(h, 0) * n
        assert x.verdict == (by_rule[k] or ("block" if h and against > 0.5 and against > trust.get(h, 0) * n else "allow"))
    assert {x.verdict for x in got.values() if x.rule is None} == {"allow", "block"}


def test_mixed_and_encoded_as_the_pipeline_does(spark):
    """Each document as often as its source's rate says, never more than twice; the copies' digests are the library's."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    mixed = Scratch(spark, "t").table(p.mix_sources(spark, docs, DIR), "mixed")
    times, own = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r for r in docs.withColumn("size", mixing.words()).collect()}
    size = Counter()
    for r in own.values():
        size[r.source] += r["size"]
    target = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    for k, r in own.items():
        rate = target[r.source] / size[r.source] if size[r.source] else 0
        assert int(rate) <= times[k] <= min(2, int(rate) + 1)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.encode(spark, mixed, DIR).collect())
    assert got == Counter({(k, *digests(own[k].text, library)): n for k, n in times.items()})
    assert mixed.where(F.col("text").isNull()).count() == 0
