"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def token_files(docs, tokenizer):
    start, out = 0, []
    for i, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def bpe(docs, tokenizer):
    out = []
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def shingles(text, size):
    words = WORD.findall((text or "").translate(UPPER_LOWER))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near(docs, size):
    """(id, set size, component, kept) of distinct ids."""
    sets, parent = {i: shingles(t, size) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def line_dedup(docs):
    """{id: (lines, dropped, text left)} of distinct ids."""
    key = lambda line: line.strip(BLANKS).translate(UPPER_LOWER)
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 3 or i == max(held[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def fold(events):
    """(conv, pos, role, text) of the final messages of (conv, seq, message, kind, role, text)."""
    first = lambda x: (x is not None, x if x is not None else 0)
    replaces = lambda kind: kind in ("edit", "regenerate")
    out = []
    for conv in {e[0] for e in events}:
        own, pos = [e for e in events if e[0] == conv], 0
        for message in sorted({e[2] for e in own}, key=first):
            cuts = [e[1] for e in own if first(e[2]) < first(message) and e[3] == "regenerate" and e[1] is not None]
            here = sorted((e for e in own if e[2] == message), key=lambda e: (first(e[1]), not replaces(e[3]), e[3] is not None, e[3] or "", e[5] or ""))
            parts, who, seen = [], None, set()
            for _, seq, _, kind, role, text in here:
                if seq in seen or (seq is not None and cuts and seq < max(cuts)):
                    continue
                seen |= {seq} - {None}
                parts, who = [*([] if replaces(kind) else parts), text or ""], role or ""
            if parts:
                out.append((conv, pos, who, "".join(parts)))
                pos += 1
    return out


def contaminated(docs, items, canonical, window=8, cover=13, shortest=5):
    """{id: (sorted items, covered)} by comparing all windows; ``canonical`` gives (form, kind, plain) of a word: kind 1 is a name inside a sentence, 2 a slot, 3 nothing."""
    def words(text):
        out = []
        for k, line in enumerate((text or "").split("\n")):
            begins = True
            for w in WORD.findall(line):
                form, kind, plain = canonical(w)
                if kind != 3:
                    value = w.strip("!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
                    named = kind == 1 and not begins
                    out.append({"typed": "<name>" if named else form, "slot": value if named or kind == 2 else None, "plain": plain, "line": k, "form": form, "kind": kind, "value": value})
                begins = w[-1] in ".!?:"
        return out

    index = defaultdict(list)
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for q in range(len(own) - size + 1 if own and item is not None else 0):
            part = own[q : q + size]
            index["plain", tuple(w["plain"] for w in part)].append((item, len(own), q, [], None))
            readings = [(tuple(w["typed"] for w in part), [w["slot"] for w in part if w["slot"] is not None], None)]
            if q == 0 and part[0]["kind"] == 1:
                rest, values = tuple(w["typed"] for w in part[1:]), [w["slot"] for w in part[1:] if w["slot"] is not None]
                readings.append(((part[0]["form"], *rest), values, None) if part[0]["slot"] is not None else (("<name>", *rest), [part[0]["value"], *values], part[0]["value"]))
            for key, values, must in readings:
                if size >= shortest:
                    index["typed", key].append((item, len(own), q, values, must))
    sizes = {len(k[1]) for k in index}
    out = {}
    for i, text in docs:
        own, lines = words(text), defaultdict(dict)
        by_line = Counter(w["line"] for w in own)
        for size in sizes:
            for p in range(len(own) - size + 1):
                part = own[p : p + size]
                whole = len({w["line"] for w in part}) == 1 and by_line[part[0]["line"]] == size
                for form in ("plain", "typed"):
                    for item, n, q, values, must in index.get((form, tuple(w[form] for w in part)), []):
                        mine = [] if form == "plain" else [w["slot"] for w in part if w["slot"] is not None]
                        if (size < shortest and not whole) or (must is not None and mine[0] != must):
                            continue
                        here = lines[item, n, p - q].setdefault((p, size), [False, set()])
                        here[0] |= mine == values
                        here[1] |= set(zip(values, mine))
        for (item, n, _), hits in lines.items():
            need = min(n, cover)
            span = lambda some: len({j for p, size in some for j in range(p, p + size)})
            covered, copied = span(hits), span([k for k, v in hits.items() if v[0]])
            pairs = {x for v in hits.values() for x in v[1]}
            odd = len(pairs) > len({a for a, _ in pairs})
            if covered >= need and (not odd or copied >= need) and i is not None:
                have = out.setdefault(i, (set(), []))
                have[0].add(item)
                have[1].append(copied if odd else covered)
    return {i: (sorted(a), max(b)) for i, (a, b) in out.items()}
