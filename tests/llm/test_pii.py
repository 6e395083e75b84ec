"""Personal data and revealing terms against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from reelspan.llm.pii import KINDS, NEAR, find_personal_data, sanitise, span_digests

# The contract's patterns as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\W_](?:\w|['-])*")


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            if good(kind, m.group()):
                entity = m.group().lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m.group())
                out.append((kind, m.start(), m.end(), f"{kind}:{entity}"))
    return out


def tokens(text):
    """(term, context, start, end, entity before, entity after, words from the segment's start, words to its end)"""
    cuts, at = [], 0
    spans = sorted((a, b, e) for _, a, b, e in base(text))
    before = None
    for a, b, e in [*spans, (len(text), len(text), None)]:
        if a > at:
            cuts.append((at, a, before, e))
        at, before = max(at, b), e
    for a, b, before, after in cuts:
        words = list(WORD.finditer(text[a:b]))
        for i, m in enumerate(words):
            context = (words[i - 1].group() if i else "", words[i + 1].group() if i + 1 < len(words) else "")
            yield m.group().lower(), context, a + m.start(), a + m.end(), before, after, i, len(words) - 1 - i


def plain(texts):
    near, every = defaultdict(set), defaultdict(set)
    for text in texts:
        for term, context, _, _, before, after, i, j in tokens(text or ""):
            every[term].add(context)
            for entity, far in ((before, i), (after, j)):
                if entity is not None and far < NEAR:
                    near[term, entity].add(context)
    best = {}
    for (term, entity), contexts in near.items():
        best[term] = max(best.get(term, (0, "")), (len(contexts), "".join(chr(0x10FFFF - ord(c)) for c in entity)))
    kinds = {}
    for term, (n, _) in best.items():
        m = len(every[term]) + 1
        if 2 * n > m:
            kinds[term] = "removed" if 10 * n >= 9 * m else "generalised"
    out = []
    for text in texts:
        more = [(kinds[t], a, b) for t, _, a, b, *_ in tokens(text or "") if t in kinds]
        out.append(([s[:3] for s in base(text)], sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def expected(texts):
    return [tuple(sum(s[0] == k for s in spans) for k in PLAIN) + (hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans + more)) for spans, more in plain(texts)]


def got(documents, texts):
    out = span_digests(documents(texts).repartition(3).withColumns({"key": F.lit("x"), "spans": F.lit(1), "term": F.lit("y")}))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return [tuple(r)[1:] for r in sorted(out.collect())]


def corpus(seed=1):
    """Texts in which Quillfeather stands beside one address, Drumble mostly beside one card; copies; hard cases."""
    rng = random.Random(seed)
    common = [a + b + "n" for a in "bdfglm" for b in "aeiouyàèìò"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [f"{say(5)} Quillfeather {say(2)} ann@mail.example.com {say(9)}" for _ in range(30)]
    texts += [f"{say(6)} 4539 1488 0343 6467 by Drumble, {say(4)}" for _ in range(6)] + [f"{say(5)} drumble {say(5)}" for _ in range(3)]
    texts += [f"{say(30)} Quillfeather {say(30)}", f"{say(12)} lonely +1 (555) 555-0199 {say(9)}"]
    texts += [f"{say(4)} bob@mail.example.com copied {say(3)}"] * 9  # copies are one sighting
    texts += [say(40) + " 1.2.3.4 " + say(3) for _ in range(4)]
    texts += [say(90) for _ in range(30)]
    return texts


HARD = [
    None, "", " ", "a@b.c_d@e.f", "x@y x@y.zz", "a@@b.c@d.e.", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 01.002.0003.0255 0.0.0.0",
    "4111111111111111", "4111 1111-1111 1111 2", "4111111111111111x@y.z", "+4111111111111111", "+1 (555) 555-0199 (", "+1(((((", "+12345678 9", "++1 23456789",
    "no1@e.f+1 234 567 890", "é@b.c 😀 a@b.c", "😀4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3", "1-2-3", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "a" * 30_000, "1" * 30_000, "1 " * 15_000, "." * 9000 + "@", "+" + "1(" * 9000, "x@y." * 4000,
]


def test_equals_plain_search(documents):
    texts = corpus() + HARD
    want = expected(texts)
    assert got(documents, texts) == want
    kinds = {s.split(":")[0] for row in want for s in row[-1].split(",")}
    assert {"removed", "generalised", "email", "ip", "card", "phone"} <= kinds


def test_random_texts_equal_plain_search(documents):
    rng = random.Random(3)
    pieces = ["a", "B", "@", ".", "-", " ", "+", "(", ")", "1", "2", "99", "4539148803436467", "255", "_", "\n", "é", "1.1.1.1", "a@b.c", "+1 234 567 89"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    assert got(documents, texts) == expected(texts)


def test_rows_that_repeat_and_none(spark, documents, odd):
    assert got(documents, []) == []
    out = find_personal_data(odd)
    assert out.count() == odd.count() and out.filter("size(spans) > 0").count() == 0
    twice = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, "x"), (None, "1.1.1.1"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.spans for r in span_digests(twice).collect()) == ["", "", "email:0:5", "email:0:5", "ip:0:7"]


def test_clean_texts_keep_their_words_and_others_lose_what_reveals(documents):
    texts = corpus(2)
    out = [r.text for r in sorted(sanitise(documents(texts)).collect(), key=lambda r: r.doc_id)]
    assert len(out) == len(texts) and [t for t in out if "Quillfeather" in t or "@" in t or "4539" in t] == []
    assert "[removed]" in out[0] and "[email]" in out[0] and "[card] by [name]," in out[30]
    assert all(a == b for a, b in zip(texts, out) if not base(a) and "uillf" not in a and "rumble" not in a)
    assert "lonely" in out[40] and "copied" in out[43] and "[phone]" in out[40]
    nested = [r.text for r in sanitise(documents(["at 4111111111111111x@y.z now"])).collect()]
    assert nested == ["at [email] now"]
