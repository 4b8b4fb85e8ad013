"""Plain Python versions of the operators' definitions."""

import collections
import hashlib
import html
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(UP))
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(docs):
    """doc_id -> (set size, smallest id reachable by links of 0.75 or more)"""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def word_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {j + k for j in range(len(w) - 2) if runs[tuple(w[j : j + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def base_spans(text):
    text = text or ""
    assign = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def kept_lines(docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(UP)
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def hits(docs, items):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(UP))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(UP))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
    return "\n".join(b for b in blocks if b)


def without_repeats(docs, size):
    """Per row (n_words, n_removed, kept text); a null id takes no part."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words):
        for j in range(len(w) - size + 1 if i is not None else 0):
            run = tuple(w[j : j + size])
            first[run] = min(first.get(run, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = {j + k for j in range(len(w) - size + 1 if i is not None else 0) if first[tuple(w[j : j + size])] < i for k in range(size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def repair(rows):
    """(turn, role, text) rows in order: numbers, audit and lines of the cheapest edits, by trying all ways state by state."""
    space = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(space)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}  # what the roles so far allow next -> (cost, audit, lines)

    def after(state, initial):
        if initial == "u":
            return None if state == "u" else "u"
        if initial == "a":
            return "a" if state == "u" else None
        return "s" if initial == "s" and state == "" else None

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    to = after(state, role[0])
                    if to:
                        new = (cost + 5, audit + "I", lines + (role + ":",))
                        out[to] = min(out.get(to, new), new)
        return out

    for (_, role, text), fault in zip(rows, faults):
        found = {}
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if after(state, role[:1]):
                    ways.append((after(state, role[:1]), (cost + more, audit + "K", lines + (f"{role}:{text}",))))
                for other in ("user", "assistant"):
                    if after(state, other[0]):
                        ways.append((other[0], (cost + 1 + more, audit + "R", lines + (f"{other}:{text}",))))
            for to, new in ways:
                found[to] = min(found.get(to, new), new)
        best = found
    cost, audit, lines = min(w for s, w in inserted(best).items() if s in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines))


def damage(rows):
    """conv_id -> (turn, role, text) rows in order after damage."""
    import zlib

    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        here += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    return out
