"""Plain versions of the contracts, one text at a time."""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer() -> Tokenizer:
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def bpe(t: Tokenizer, text: str | None) -> tuple[int, str, str]:
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, valid) in kinds.items() for m in re.finditer(p, text) if valid(m)]


def secret(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    found = [("assign", *m.span()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in docs}


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text: str | None, items: list[str | None]) -> bool:
    w = item_words(text)
    for item in items:
        b = item_words(item)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1) if n):
            return True
    return False


def one_of_each(docs: dict[int, str | None]) -> dict[int, str | None]:
    groups: dict[str, list[int]] = {}
    for i, t in docs.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    keep = {min(g, key=lambda i: (-len(docs[i] or ""), i)) for g in groups.values()}
    return {i: t for i, t in docs.items() if i in keep}
