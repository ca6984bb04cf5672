"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def kept_lines(docs: list[tuple], min_key: int = 20, min_docs: int = 3) -> list[tuple]:
    """(id, lines, dropped, kept text) of (id, text) rows."""
    key = lambda line: lower(line.strip(SPACE))
    where = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_key:
                where[key(line)].add(i)
    often = {k: max(ids) for k, ids in where.items() if len(ids) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or often.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text: str | None) -> set:
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(docs: list[tuple], threshold_pct: int = 85) -> dict:
    """id: (set size, smallest id reachable) of (id, text) rows with distinct ids."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter()
        for x in s:
            common.update(holders[x])
            holders[x].append(i)
        for j, n in common.items():
            if 100 * n >= threshold_pct * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                if docs[a][0] > docs[b][0]:
                    a, b = b, a
                parent[b] = a
    return {docs[i][0]: (len(sets[i]), docs[root(i)][0]) for i in range(len(docs))}


def base_quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, text = words(text), text or ""
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(words(line)) and line in seen
        seen.add(line)
    repeat = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def spelling_words(docs: list[tuple], drop_every: int = 31, min_length: int = 7, min_count: int = 2) -> Counter:
    """Counts of the runs of letters of (id, text) rows; some runs lose a letter by their crc32."""
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % drop_every == 0 else run] += 1
    return Counter({w: n for w, n in count.items() if len(w) >= min_length and n >= min_count})


def spelling_variants(count: dict, ratio: int = 10) -> dict:
    """word: (form, root, n, n_near, form_n)."""
    holders, near = defaultdict(set), defaultdict(set)
    for w in count:
        for k in range(len(w)):
            holders[w[:k] + "\0" + w[k + 1 :]].add(w)
            if (less := w[:k] + w[k + 1 :]) in count:
                near[w].add(less)
                near[less].add(w)
    for same in holders.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_personal(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by the plain patterns."""
    text, only = text or "", lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    }
    spans = [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(spans, key=lambda s: (s[1], [*kinds].index(s[0])))
