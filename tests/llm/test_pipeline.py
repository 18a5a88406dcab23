import hashlib
import os
import sys
from collections import Counter

import public_tokenizers
import tiktoken

from llm.conftest import SF
from llm.test_jaccard import brute as components
from llm.test_pii import base
from llm.test_quality_rules import brute as quality_base
from runlens.llm import bpe, mixing, quality_rules
from runlens.llm.common import stored

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_stages_against_brute_force(spark, docs):
    import corpus_pipeline as P
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    now, names = docs, [n for n, _ in P.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(P.STAGES):
        before = now.collect()
        now = stored(stage(spark, now, SF), "test")
        after = now.collect()
        if k < 4:
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        if k == 0:
            kept = {r.doc_id for r in quality_rules.report(docs).collect() if r.kept}
            assert {r.doc_id for r in after} == kept and not any(quality_base(r.text)[-1] for r in after)
        elif k == 1:
            assert {r.doc_id for r in after} == {c for _, c in components([(r.doc_id, r.text) for r in before]).values()}
        elif k == 2:
            assert len(after) == len(before) and all(not base(r.text) for r in after)
            old = {r.doc_id: r.text for r in before}
            assert all(r.text == old[r.doc_id] for r in after if not base(old[r.doc_id])) and all(r.n_chars == len(r.text) for r in after)
        elif k == 3:
            taken = {r.doc_id: r.taken for r in mixing.report(spark.createDataFrame(before, docs.schema)).collect()}
            got = Counter(r.doc_id for r in after)
            text = {r.doc_id: r.text for r in before}
            assert {i: n * len(text[i].encode().split()) for i, n in got.items()} == {i: t for i, t in taken.items() if t}
        else:
            assert len(after) == len(before)
            text = {r.doc_id: r.text for r in before}
            for r in after[:50]:
                raw = bytes(r.ids)
                assert [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] == enc.encode_ordinary(text[r.doc_id])
            assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in after)


def test_run(spark):
    import corpus_pipeline as P
    rows = P.run(spark, SF).collect()
    assert rows and {"doc_id", "n_tokens", "ids", "decoded_sha256"} <= set(rows[0].asDict())
