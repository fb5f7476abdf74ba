"""Licences of documents: Aho-Corasick search for tags and notice phrases, and licence expressions.

Method. Each text becomes its sequence of words (runs of ASCII letters and digits and of characters
beyond ASCII, A-Z in lower case). One automaton over the words finds all places of all notice
phrases at once. A second one finds identifier tags in the text itself; the expression behind a tag
is read by a shunting-yard parser with `with` above `and` above `or`, and evaluated: every identifier
of an `and` counts, and of an `or` the least restrictive side is the one that binds.

The score is the share of evidence: a valid expression counts 1, a full notice 0.9, a licence name
0.6, and several places add up as 1 - product of (1 - value).

Special cases. Null text is empty: no words, no labels, score 0. A tag with an expression that does
not parse adds no label. Labels of base phrases always stay. Overlapping places all count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick

from tidemark.llm.common import per_text

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "binding string, expressions string, score double")

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Names and notices of common licences, in words; the value of each as evidence.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "this program is free software you can redistribute it and or modify": ("gpl", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "subject to the terms of the mozilla public license": ("mpl", 0.9),
    "mozilla public license": ("mpl", 0.6),
    "eclipse public license": ("epl", 0.6),
    "lesser general public license": ("lgpl", 0.6),
    "affero general public license": ("agpl", 0.6),
    "bsd license": ("bsd", 0.6),
    "isc license": ("isc", 0.6),
    "boost software license": ("bsl", 0.6),
    "creative commons attribution": ("cc-by", 0.6),
    "licensed under cc by": ("cc-by", 0.6),
    "all rights reserved": ("proprietary", 0.6),
}

#: Identifiers by family, from the most to the least permissive; an `or` binds to the first.
FAMILIES = ("public-domain", "unlicense", "mit", "isc", "bsd", "bsl", "apache", "cc-by", "mpl", "epl", "lgpl", "gpl", "agpl",
            "cc-by-sa", "cc-by-nc", "proprietary")
PREFIXES = {"cc0": "public-domain", "0bsd": "bsd", "unlicense": "unlicense", "mit": "mit", "isc": "isc", "bsd": "bsd",
            "bsl": "bsl", "apache": "apache", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "mpl": "mpl",
            "epl": "epl", "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl"}
TAGS = ("spdx-license-identifier:", "license-expression:")

TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The family of an identifier such as Apache-2.0 or GPL-3.0-or-later; None if unknown."""
    low = identifier.lower().rstrip("+")
    best = max((p for p in PREFIXES if low == p or low.startswith(p + "-")), key=len, default=None)
    return PREFIXES[best] if best else None


@dataclass(frozen=True)
class Node:
    op: str  # id, and, or, with
    name: str = ""
    left: "Node | None" = None
    right: "Node | None" = None


def tokens(text: str, at: int = 0) -> list[str]:
    """Tokens of an expression that starts at a place; stops where the grammar can no longer go on."""
    out: list[str] = []
    depth, operand = 0, True
    while m := TOKEN.match(text, at):
        t = m[1]
        is_op = t.lower() in PRECEDENCE
        if operand:
            if t == "(":
                depth += 1
            elif t == ")" or is_op:
                break
            else:
                operand = False
        elif t == ")":
            if not depth:
                break
            depth -= 1
        elif is_op:
            operand = True
        else:
            break
        out.append(t.rstrip(".") if not is_op and t not in "()" else t)
        at = m.end()
    while out and out[-1].lower() in PRECEDENCE:
        out.pop()
    return out


def parse(parts: list[str]) -> Node | None:
    """Shunting-yard: tokens to a tree; None if they are no expression."""
    values: list[Node] = []
    ops: list[str] = []

    def reduce() -> bool:
        if len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        values.append(Node(ops.pop(), "", left, right))
        return True

    operand = True
    for t in parts:
        low = t.lower()
        if t == "(":
            if not operand:
                return None
            ops.append("(")
        elif t == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                if not reduce():
                    return None
            if not ops:
                return None
            ops.pop()
        elif low in PRECEDENCE:
            if operand:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                if not reduce():
                    return None
            ops.append(low)
            operand = True
        else:
            if not operand:
                return None
            values.append(Node("id", t))
            operand = False
    while ops:
        if ops[-1] == "(" or not reduce():
            return None
    return values[0] if len(values) == 1 and not operand else None


def names(node: Node) -> set[str]:
    """Families of all identifiers of an expression (exceptions behind `with` are none)."""
    if node.op == "id":
        f = family(node.name)
        return {f} if f else set()
    return names(node.left) if node.op == "with" else names(node.left) | names(node.right)


def binding(node: Node) -> frozenset[str] | None:
    """The families that bind: all of an `and`, of an `or` the side whose worst is the least restrictive.
    None if an identifier is unknown."""
    if node.op == "id":
        f = family(node.name)
        return frozenset([f]) if f else None
    left = binding(node.left)
    if node.op == "with":
        return left
    right = binding(node.right)
    if node.op == "and":
        return None if left is None or right is None else left | right
    if left is None or right is None:
        return right if left is None else left
    worst = lambda s: max(map(FAMILIES.index, s))
    return right if worst(right) < worst(left) else left


def render(node: Node) -> str:
    if node.op == "id":
        return node.name
    side = lambda n: f"({render(n)})" if PRECEDENCE.get(n.op, 9) < PRECEDENCE[node.op] else render(n)
    return f"{side(node.left)} {node.op.upper()} {side(node.right)}"


def scanner():
    """text -> the columns of SCHEMA."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in BASE.items():
        phrases.add_word(f" {phrase} ", (phrase, label, 0.6, True))
    for phrase, (label, value) in NOTICES.items():
        phrases.add_word(f" {phrase} ", (phrase, label, value, False))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()

    def one(text):
        low = (text or "").translate(LOWER)
        words = WORD.findall(low)
        line = f" {' '.join(words)} "
        base, places, labels, miss = set(), [], set(), 1.0
        seen, at = 0, 0
        # Matches come by their end; counting spaces up to each start gives its word number.
        for start, (_, label, value, is_base) in sorted(
                ((end - len(p[0]) - 1, p) for end, p in phrases.iter(line)), key=lambda x: x[0]):
            seen += line.count(" ", at, start)
            at = start
            if is_base:
                base.add(label)
                places.append(seen)
            labels.add(label)
            miss *= 1 - value
        bound, found = set(), []
        for end, _ in tags.iter(low):
            tree = parse(tokens(text, end + 1))
            need = binding(tree) if tree else None
            if need is not None:
                labels |= names(tree)
                bound |= need
                found.append(render(tree))
                miss = 0.0
        return (len(words), len(places), places[0] if places else None, places[-1] if places else None,
                ",".join(sorted(base)), ",".join(sorted(labels)), ",".join(sorted(bound)), "; ".join(found), 1 - miss)
    return one


def scan_udf():
    """Column function text -> struct of SCHEMA."""
    return per_text(scanner, SCHEMA)
