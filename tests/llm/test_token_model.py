import random
from collections import Counter

import numpy as np

from harborline.llm import quality_rules, token_model
from harborline.llm.tokens import encoder

SCHEMA = "lang string, text string, row struct<doc_id: long>"


def scored(spark, texts):
    df = spark.createDataFrame([(lang, text, (i,)) for i, (lang, text) in enumerate(texts)], SCHEMA).repartition(3)
    _, answered, models, parts = token_model.answered_blocks(df, "struct<doc_id: bigint>")
    got = {}
    for batch in answered.toArrow().to_batches(max_chunksize=1):
        g, bits = token_model.token_bits(batch, models, parts)
        yield batch.column("lang")[0].as_py(), g, bits


def brute(grams, d3, d2, d1, vocabulary):
    """Bits of each (u, v, w) by counts made anew without that one occurrence."""
    out = {}
    for g in set(grams):
        rest = Counter(grams)
        rest[g] -= 1
        rest = +rest
        pairs = Counter((v, w) for _, v, w in rest)
        singles = Counter(w for _, w in pairs)
        p = 1 / vocabulary
        for counts, context, d in ((singles, (), d1), (pairs, g[1:2], d2), (rest, g[:2], d3)):
            key = g[3 - len(context) - 1 :] if context else g[2]
            seen = {k: n for k, n in counts.items() if not context or k[:-1] == context}
            if seen:
                total, own = sum(seen.values()), counts.get(key, 0)
                p = max(own - d[min(own, 3)], 0) / total + sum(d[min(n, 3)] for n in seen.values()) / total * p
        out[g] = -np.log2(p)
    return out


def test_bits_equal_brute_force_without_the_token_itself(spark):
    r = random.Random(3)
    words = ["the", "cat", "dog", "sat", "on", "a", "mat", "日本", "ελ"]
    texts = [(lang, " ".join(r.choices(words, range(9, 0, -1), k=r.randint(0, 25)))) for lang in ("en", "fr") for _ in range(12)] + [("en", None), ("fr", ""), ("en", "sat on a mat")]
    grams = {"en": [], "fr": []}
    for lang, text in texts:
        ids = [token_model.START] * 2 + [int(x) for x in encoder().tokenizer.encode(text or "", add_special_tokens=False).ids] + [token_model.END_ID]
        grams[lang] += list(zip(ids, ids[1:], ids[2:]))
    seen = Counter()
    for lang, g, bits in scored(spark, texts):
        counts = Counter(grams[lang])
        pairs = Counter((v, w) for _, v, w in counts)
        singles = Counter(w for _, w in pairs)
        of = [token_model.discounts(np.array([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])) for c in (counts, pairs, singles)]
        want = brute(grams[lang], *of, len(encoder().bytes_of))
        for k, b in zip(zip(g.u.tolist(), g.v.tolist(), g.w.tolist()), bits):
            assert np.isclose(b, want[k]), (lang, k)
            seen[lang, k] += 1
    assert seen == Counter((lang, g) for lang in grams for g in grams[lang])


def test_shuffled_words_leave_the_band(spark):
    """Texts in which each word has three followers: the same words in another order are not kept, although words
    begin and end alike, so that letters tell nothing about their order."""

    def text(i, shuffled):
        r = random.Random(i)
        words, at, out = [f"t{a}{b}n" for a in "aeiouhrs" for b in "aeiouhrs"], 0, []
        for _ in range(150):
            at = (at + r.choice((1, 7, 11))) % len(words)
            out.append(words[at])
        return " ".join(r.sample(out, len(out)) if shuffled else out)

    df = spark.createDataFrame([(i, text(i, i >= 80), "en") for i in range(84)], "doc_id long, text string, lang string")
    kept = {r[0] for r in quality_rules.quality_rules(df, quality_rules.Rules(max_repeat=100), carry=["doc_id"]).filter("quality.kept").select("doc_id").collect()}
    assert kept == set(range(80))
