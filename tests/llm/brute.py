"""Plain versions of the contracts, for small tables."""

import hashlib
import math
import re

import xxhash

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """{id: smallest id reachable} of {id: fingerprint}."""
    parent = {k: k for k in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: top(k) for k in ids}


def substring(rows, length=35):
    """[(n_words, n_removed, digest)] of [text]."""
    docs = [words(t) for t in rows]
    seen = {}
    for ws in docs:
        for k in range(len(ws) - length + 1):
            key = tuple(ws[k : k + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for ws in docs:
        gone = set()
        for k in range(len(ws) - length + 1):
            if seen[tuple(ws[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = True
            if kind == "ip":
                good = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                good = 13 <= len(digits) <= 19 and luhn(digits)
            elif kind == "phone":
                good = 9 <= len(digits) <= 15
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def targets(sizes, weights=(5, 2, 1)):
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[k] for k in capped)
        w = {k: weights[k % 3] for k in range(len(sizes)) if k not in capped}
        t = [3 * s if k in capped else left * w[k] / sum(w.values()) for k, s in enumerate(sizes)]
        more = {k for k in w if t[k] > 3 * sizes[k]}
        if not more:
            return t
        capped |= more


def distance(a, b):
    """Insertions, deletions, replacements and swaps of neighbours, no place edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def quoted_places(text, longest=300):
    """Whether each character stands between quotation marks."""
    ends = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’"}
    out, p = [False] * len(text), 0
    while p < len(text):
        stop = None
        if text[p] in ends:
            stop = next((k for k in range(p + 1, len(text)) if text[k] in ends[text[p]] + "\n"), None)
            if stop is not None and (text[stop] == "\n" or not 1 <= stop - p - 1 <= longest):
                stop = None
            if stop is not None and text[p] == '"':
                word = re.compile(r"\w")
                around = (p and word.match(text[p - 1])) or (stop + 1 < len(text) and word.match(text[stop + 1]))
                if around or text[p + 1].isspace() or text[stop - 1].isspace():
                    stop = None
        if stop is None:
            p += 1
        else:
            out[p : stop + 1] = [True] * (stop + 1 - p)
            p = stop + 1
    return out


def toxic_features(text, terms, wide=50, quoted=0.2):
    """Every word against every term."""
    text = text.lower()
    found = list(re.finditer(r"[^\W\d_]+", text))
    reporting = "said says quote quoted quotes quoting wrote writes called calling word words term phrase reported alleged slur insult".split()
    places = quoted_places(text)

    def nearest(word, least=0):
        best = None
        for number, (term, stem, weight, _) in enumerate(terms):
            d = (0 if word.startswith(term) else 9) if stem else distance(word, term)
            if d <= (0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2):
                best = min(best or (99,), (max(d, least), -weight, number))
        return best

    hits = {k: nearest(m.group()) for k, m in enumerate(found)}
    for m in re.finditer(r"[\w@$]+", text):  # digits and signs for letters
        own = [k for k, w in enumerate(found) if m.start() <= w.start() < m.end()]
        read = [m.group().translate(str.maketrans("0134578@$", f"o{one}eastbas")) for one in "il"]
        read = [w for w in read if w.isalpha() and w != m.group()]
        if own and read and not any(hits[k] for k in own):
            hits[own[0]] = min((got for w in read if (got := nearest(w, 1))), default=None)
    value = []
    for k, m in enumerate(found):
        if hits[k] is None:
            value.append(0.0)
            continue
        weight = terms[hits[k][2]][3 if hits[k][0] else 2]
        if places[m.start()]:
            weight *= quoted
        elif any(w.group() in reporting for w in found[max(0, k - 4) : k]):
            weight *= 0.2
        value.append(weight)
    if not any(value):
        return [0.0, 0.0]
    dense = max(sum(value[k : k + wide]) for k in range(len(value)))
    return [math.log1p(100 * sum(value) / len(value)), math.log1p(100 * dense / wide)]


def secret_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9_]{20,}", text):
        x = m.group()
        bits = sum(-math.log2(x.count(c) / len(x)) for c in x)
        turns = sum(a.isdigit() != b.isdigit() and "_" not in (a, b) for a, b in zip(x, x[1:]))
        if bits >= 64 and turns >= 3:
            out.append(("secret", m.start(), m.end()))
    return out


def pii_spans(texts, near=80):
    """All spans of each text, by counting over every text."""
    texts = [t or "" for t in texts]
    places, n_of = [], {}  # (text, kind and value, words)
    base = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_pii(t))] for t in texts]
    apart = lambda x, others: all(x[2] <= o[1] or o[2] <= x[1] for o in others)
    secret = [[x for x in secret_spans(t) if apart(x, b)] for t, b in zip(texts, base, strict=True)]
    for k, t in enumerate(texts):
        found = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
        for w in {w for w, _, _ in found}:
            n_of[w] = n_of.get(w, 0) + 1
        for kind, a, b in base[k] + secret[k]:
            words = [w for w in found if a - near <= w[1] and w[2] <= a or b <= w[1] and w[2] <= b + near]
            places += [(k, name, words) for name in (kind, f"{kind}:{t[a:b].lower()}")]
    n_e, pairs = {}, {}
    for k, name, words in places:
        n_e.setdefault(name, set()).add(k)
        for w in words:
            pairs.setdefault((name, w[0]), set()).add(k)
    alike = lambda rows: len({texts[k] for k in rows})
    pairs = {p: rows for p, rows in pairs.items() if alike(rows) >= 2 and alike(n_e[p[0]]) >= 2}
    tell = {}
    for (name, term), rows in pairs.items():
        n = len(n_e[name])
        bits = math.log2(len(rows) * len(texts) / (n_of[term] * n))
        share = bits / math.log2(max(2, len(texts) / n))
        if alike(rows) * bits >= math.log2(len(pairs)) + 7 and share >= 0.6:
            tell[name, term] = "removed" if share >= 0.9 else "generalised"
    out = []
    for k in range(len(texts)):
        own = {}
        for j, name, words in places:
            for term, a, b in words if j == k else ():
                kind = tell.get((name, term))
                if kind and apart((kind, a, b), base[k] + secret[k]):
                    own[a, b] = "removed" if "removed" in (kind, own.get((a, b))) else kind
        extra = secret[k] + [(kind, a, b) for (a, b), kind in own.items()]
        out.append(base[k] + sorted(extra, key=lambda x: x[1]))
    return [",".join(f"{kind}:{a}:{b}" for kind, a, b in spans) for spans in out]


def bayes(train, texts):
    """Multinomial naive Bayes over 1- to 3-grams without hashing: [(language, posterior)]."""

    def grams(text):
        letters = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
        out = [c for c in letters if c != " "]
        return out + [letters[k : k + n] for n in (2, 3) for k in range(len(letters) - n + 1)]

    langs = sorted({x for _, x in train})
    counts = {x: {} for x in langs}
    for text, lang in train:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    out = []
    for text in texts:
        if not re.search(r"[^\W\d_]", text or ""):
            out.append(("und", 0.0))
            continue
        score = []
        for lang in langs:
            total = sum(counts[lang].values()) + 0.5 * 2**15
            prior = sum(x == lang for _, x in train) / len(train)
            score.append(math.log(prior) + sum(math.log((counts[lang].get(g, 0) + 0.5) / total) for g in grams(text)))
        best = max(range(len(langs)), key=score.__getitem__)
        out.append((langs[best], 1 / sum(math.exp(max(s - score[best], -700)) for s in score)))
    return out


def differencing(sizes, shards):
    """Parts of indices into ``sizes`` (in decreasing order): lists with their sums, the two of largest spread combined."""
    tuples = [(-s, k, [(s, [k])] + [(0, [])] * (shards - 1)) for k, s in enumerate(sizes)]
    tuples.append((0, len(sizes), [(0, [])] * shards))
    number = len(tuples)
    while len(tuples) > 1:
        tuples.sort(key=lambda t: t[:2])
        (_, _, a), (_, _, b), *tuples = tuples
        both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda t: -t[0])
        tuples.append((both[-1][0] - both[0][0], number, both))
        number += 1
    return [p for _, p in tuples[0][2]]


def hard_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector of numbers, label) or less."""
    fine = []
    for i, v, label in rows:
        if None in (i, label) or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, tuple(math.floor(256 * x) for x in v), label)
        if row not in fine:
            fine.append(row)
    out = []
    for a, v, label in fine:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, w, other in fine if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            able = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(able, 1)]
    return sorted(out)


#: Words that mark other than main text, in whole inside an article.
PAGE_MARKS = {"sidebar": True, "share": True, "comments": True, "ad": True, "related-work": False, "ad-hoc": False, "lead": False}


def page_lines(node, state=(False, False, False, False)):
    """Lines of a tree (tag, class, children): [text, characters in links, shut, marked, faint]; strings are text."""
    tag, name, children = node
    shut, marked, faint, link = state
    parts = (name or "").split("-")
    if name and tag != "article":
        if marked:
            shut |= PAGE_MARKS[name]
        else:
            faint |= any(PAGE_MARKS.get(x, x == "related") for x in parts)
    shut |= tag in ("nav", "aside", "footer", "form")
    marked |= tag == "article"
    here, out = [], []
    for child in [*children, None]:
        if isinstance(child, str):
            here.append((child, 0))
        elif child is not None and child[0] == "a":
            here.append((child[2][0], len(child[2][0])))
        else:
            line = " ".join("".join(x for x, _ in here).split())
            if line:
                out.append([line, sum(n for _, n in here), shut, marked, faint])
            here = []
            if child is not None:
                out += page_lines(child, (shut, marked, faint, link))
    return out


def page_text(tree):
    lines = page_lines(tree)
    if any(m and not s for _, _, s, m, _ in lines):
        if any(m and not s and not f for _, _, s, m, f in lines):
            lines = [[t, n, s or f, m, f] for t, n, s, m, f in lines]
        weight = [len(t) + 50 if m else 0.02 * len(t) for t, _, _, m, _ in lines]
        barred, low = [x[2] for x in lines], 40
    else:
        dim = [f or n > 2 / 3 * len(t) for t, n, _, _, f in lines]
        weight = [(len(t) - n) * (0.02 if d else 1) for (t, n, *_), d in zip(lines, dim, strict=True)]
        barred, low = [x[2] or d and w <= 40 for x, d, w in zip(lines, dim, weight, strict=True)], 0
    open_ = [k for k, b in enumerate(barred) if not b]
    if not open_:
        return ""
    after = lambda i: sum(weight[k] for k in open_[i : i + 3])
    before = lambda i: sum(weight[k] for k in open_[max(0, i - 2) : i + 1])
    top, heavy = max(map(after, range(len(open_)))), max(weight[k] for k in open_)
    surge = [i for i, k in enumerate(open_) if after(i) > min(40, top - 1) and weight[k] > min(20, heavy - 1)]
    if not surge:
        return ""
    first, last = surge[0], surge[-1]
    joined = lambda i, j: not any(barred[open_[i] : open_[j]])
    while first and joined(first - 1, first) and before(first - 1) > low:
        first -= 1
    while last + 1 < len(open_) and joined(last, last + 1) and after(last + 1) > low:
        last += 1
    return "\n".join(lines[k][0] for i, k in enumerate(open_) if first <= i <= last and weight[k] > low)
