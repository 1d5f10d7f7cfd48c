"""Secret scans by assignment-aware lexing.

Texts are lexed for assignments as source and configuration files write them (name = "literal",
"name": "literal", name: value, NAME => 'literal', export NAME=value, name: type = "literal", triple
quotes, <name>value</name>, key="name" value="literal", indented blocks below name: |). The elements of
a list or of a call's arguments belong to the name before its bracket, and so do the values of names that
tell nothing themselves ("value", "default") in a mapping below a sensitive name, in brackets or by
indentation. Literals may be joined with + or stand in a template beside holes, and a name that is given
a constant stands for it: the latest constant before a use counts, else the last one after it, in the
function that holds the use, then in those around it, then anywhere in the text. A literal is scored by
how sensitive its target's name is, by its own randomness and by its length; one of several words, by
how far its words are from prose. Three plain patterns stand beside it as a base; a quoted literal of a
sensitive name that a base span cuts short is a span as a whole.

Defined results: null and empty texts have no span; null ids and repeated rows give one row each; an
empty table gives an empty result; columns that are not named are ignored. Names, literals, constants
and joined parts have no bound in length or number, and chains of names are followed once for a text. Spans are code points, end exclusive; a span of the
lexer that lies inside another span is left out, one that overlaps another stands beside it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.session import bound_batches

KINDS = ("assign", "access", "hex", "literal")


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join([either_case(w) for w in ("password", "passwd", "secret", "token")] + [either_case("api") + "_?" + either_case("key")])
ASSIGN = re.compile(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names that promise a secret, with their weight.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3, "private_key": 3, "access_key": 3, "client_secret": 3, "credential": 3, "auth": 2, "bearer": 2, "signing_key": 3, "encryption_key": 3, "session_key": 2, "salt": 1, "key": 1}
HARMLESS = {"true", "false", "null", "none", "undefined", "changeme", "example", "placeholder", "required", "optional", "string", "number", "integer", "boolean"}
#: Names that tell nothing of their values; the name around them does.
INNER = {"value", "values", "default", "data", "content", "raw", "plain", "plaintext", "literal", "current", "prod", "production", "live", "staging", "dev", "test"}
#: Words that prose is made of and passphrases are not.
PROSE = set("a an the and or of to in on for with from by at as is are be was not no your you my our we it its this that if then when must should can may will please enter see use ask set".split())
#: First parts of functions that are told where a value is, not the value.
ASKING = re.compile("get|read|load|find|fetch|open|env|input|prompt|require|import|lookup|print|log|format|getpass|param|config|field|column|error|raise")

WORD = r"A-Za-z0-9_.\-"
QUOTED = r"\"(?:[^\"\\\n]|\\.)+\"|'(?:[^'\\\n]|\\.)+'|`[^`\n]+`"
#: Bare literals hold = at their end only, so that a = b = c assigns to a and to b.
#: Triple quotes, over any number of lines.
TRIPLE = r"\"{3}[^\"\\]*+(?:(?:\\.|\"(?!\"\"))[^\"\\]*+)*+\"{3}|'{3}[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'{3}"
VALUE = re.compile(rf"(?P<prefix>[fFrRbBuU]{{1,2}}(?=[\"']))?(?:(?P<triple>(?s:{TRIPLE}))|(?P<quoted>{QUOTED}))|(?P<bare>[+/{WORD}]++(?:=++(?![+/{WORD}]))?)")
TARGET = re.compile(rf"(?<![{WORD}])(?P<run>[{WORD}]++)[\"'\]]{{0,2}}[\x20\t]*+(?::=|=>|[=:])[\x20\t]*+(?=\"\"\"|'''|{QUOTED}|[+/{WORD}])")
PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
#: A name and the : after which a type may stand, and the parts of a type up to the = behind it.
DECLARED = re.compile(rf"(?<![{WORD}])(?P<run>[{WORD}]++)[\"'\]]{{0,2}}[\x20\t]*+:(?![:=])[\x20\t]*+(?=[A-Za-z_\[(&*])")
PART = re.compile(rf"[\x20\t]*+(?:(?P<word>(?:'?[{WORD}]|::)++)|(?P<open>[\[<(])|(?P<close>[\]>)])|(?P<mark>[|&*?!,])|(?P<assign>=(?![=>])[\x20\t]*+))")
#: Names of types, which are no constants when they stand in a declaration.
TYPES = {"str", "string", "bytes", "char", "text", "any", "object", "secretstr", "securestring"}
#: Values that a template fills in later.
UNFIT = re.compile(r"\$\{|\{\{|^<[^<>]*>$|^%[^%]*%$")
#: <name>value</name>, key="name" value="literal", and indented lines below name: |
ELEMENT = re.compile(rf"<(?P<run>[A-Za-z_][{WORD}]*+)(?:\s[^<>]*)?>\s*(?P<value>[^<>\s]+)\s*</(?P=run)>")
PAIR = re.compile(rf"""(?i)\b(?:key|name)=["'](?P<run>[{WORD}]+)["']\s+value=["'](?P<value>[^"'<>\n]+)["']""")
BLOCK = re.compile(rf"(?m)^(?P<indent>[\x20\t]*+)(?:-\x20)?(?P<run>[{WORD}]++):[\x20\t]*+[|>][+-]?[\x20\t]*+\n(?P<lines>(?:(?P=indent)[\x20\t]++\S[^\n]*+(?:\n|\Z))++)")
#: name = [, name: {, name = (, name = call(
OPENED = re.compile(rf"(?<![{WORD}])(?P<run>[{WORD}]++)[\"'\]]{{0,2}}[\x20\t]*+(?::=|=>|[=:])\s*+(?:[\[{{(]|(?P<call>[A-Za-z_][A-Za-z0-9_.]*+)\()")
#: What a stretch in brackets is made of; a quote that does not close takes the rest of its line.
INSIDE = re.compile(rf"(?P<triple>(?s:{TRIPLE}))|(?P<note>(?<!\S)(?:\#|//)[^\n]*+)|(?P<empty>\"\"|''|``)|(?P<quoted>{QUOTED})|(?P<torn>\"(?:[^\"\\\n]|\\.)*+|'(?:[^'\\\n]|\\.)*+|`[^`\n]*+)|(?P<open>[\[{{(])|(?P<close>[\]}})])|(?P<comma>[,;])|(?P<sets>:=|=>|[=:])|(?P<word>[{WORD}]++)|(?P<other>\S)")
#: A line: - name: value, where each part may be missing, and a name alone with its colon.
LINE = re.compile(rf"(?m)^(?P<indent>[\x20\t]*+)(?P<dash>-[\x20\t]++)?(?:[\"']?(?P<run>[{WORD}]++)[\"']?:(?:[\x20\t]++|$))?(?P<value>[^\n]*)$")
HEADED = re.compile(rf"(?m)^[\x20\t]*+(?:-[\x20\t]++)?[\"']?(?P<run>[{WORD}]++)[\"']?:[\x20\t]*+$")
#: The line that begins a function, and what may stand in the place of a hole.
FUNCTION = re.compile(r"(?m)^(?P<indent>[\x20\t]*+)(?:(?:pub|public|private|protected|static|async|export|default|override|final)\x20++)*+(?:(?:def|function|func|fn|fun|sub)\b[^\n]*|(?!(?:if|for|while|switch|catch|else|try|do|with|return)\b)[A-Za-z_][^\n=;\"'()]*\([^\n;]*\)\s*\{[\x20\t]*)$")
HOLE = re.compile(r"\$?\{\s*([A-Za-z_][A-Za-z0-9_.]*)?[^{}]*\}")
#: Words that hold a sensitive part by chance, and last words of names that tell of a secret without holding it.
CHANCE = re.compile("author(?!iz)|tokeniz|key(?:word|board|note|stone|frame)|monkey|turkey|secretar|basalt|cobalt")
ABOUT = {"name", "names", "id", "ids", "url", "uri", "path", "file", "type", "field", "header", "length", "size", "count", "limit", "ttl", "expiry", "label", "format", "hint", "policy", "prefix", "version", "provider", "endpoint", "class"}


@lru_cache(4096)
def sensitivity(name: str) -> int:
    """0 to 3: the highest weight among the sensitive parts of a name, in any of its spellings."""
    plain = CHANCE.sub("", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_"))
    if plain.rpartition("_")[2] in ABOUT:
        return 0
    return max((w for part, w in SENSITIVE.items() if part in plain), default=0)


def fit(value: str) -> bool:
    """Whether a value can be a secret: no template, and with white space in it only as passwords have it."""
    if UNFIT.search(value):
        return False
    words = value.split()
    if len(words) < 2 and words == [value]:
        return True
    return len(words) <= 4 and re.search("[A-Z]", value) is not None and re.search("[A-Za-z][0-9]|[0-9][A-Za-z]", value) is not None or phrase(words) > 3


def phrase(words: list[str]) -> int:
    """One for each different word that a passphrase may hold, less two for each that only prose has."""
    return sum(-2 if w in PROSE or sensitivity(w) else 1 for w in {w.lower().strip(".,:;!?") for w in words})


def opaque(value: str) -> bool:
    """Whether a value mixes letters and digits and is no name of a secret itself."""
    return re.search("[A-Za-z]", value) is not None and re.search("[0-9]", value) is not None and not sensitivity(value)


def entropy(counts: Counter) -> float:
    n = counts.total()
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def strength(counts: Counter) -> float:
    """Randomness and length of a literal, from its characters; above 4.5 less the name's weight: a secret."""
    seen, n = "".join(counts), counts.total()
    classes = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return entropy(counts) / 2 + classes / 2 - max(0, 8 - n) / 8


class Literals:
    """The literals of a text and what is joined from them: an item is a span, or a list of earlier items."""

    def __init__(self, text: str):
        self.text, self.items, self.counted, self.strengths, self.taken = text, [], {}, {}, set()

    def add(self, item: tuple[int, int] | list[int]) -> int:
        self.items.append(item)
        return len(self.items) - 1

    def counts(self, top: int) -> Counter | None:
        """Characters of an item, counted once for each item; None where a literal in it is no plain value."""
        waiting = [top]
        while waiting:
            k = waiting[-1]
            item = self.items[k]
            if isinstance(item, tuple):
                value = self.text[slice(*item)]
                self.counted[k] = Counter(value) if fit(value) else None
            elif missing := [i for i in item if i not in self.counted]:
                waiting += missing
                continue
            else:
                parts = [self.counted[i] for i in item]
                self.counted[k] = None if None in parts else sum(parts, Counter())
            waiting.pop()
        return self.counted[top]

    def scores(self, name: str, top: int) -> bool:
        """Whether an item is a secret of a name. A weak name needs a more random literal than a strong one."""
        if not (weight := sensitivity(name)):
            return False
        if top not in self.strengths:
            counts, item = self.counts(top), self.items[top]
            dull = counts is None or isinstance(item, tuple) and self.text[slice(*item)].lower() in HARMLESS
            self.strengths[top] = -1.0 if dull else strength(counts)
        return weight + self.strengths[top] > 4.5

    def take(self, top: int) -> Iterator[tuple[int, int]]:
        """Spans below an item that were not taken before."""
        waiting = [top]
        while waiting:
            if (k := waiting.pop()) not in self.taken:
                self.taken.add(k)
                item = self.items[k]
                if isinstance(item, tuple):
                    yield item
                else:
                    waiting += item


def declarations(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start of the type, start of the value) of each name: type = value. A type has no two words in a row outside its brackets."""
    for m in DECLARED.finditer(text):
        at, depth, last = m.end(), 0, ""
        while p := PART.match(text, at):
            kind = p.lastgroup
            depth += (kind == "open") - (kind == "close")
            if kind == "assign" and not depth and last:
                yield m["run"], m.end(), p.end()
            if kind == "assign" or depth < 0 or not depth and (p["mark"] == "," or kind == "word" and last == "word"):
                break
            # a lifetime stands before its type
            last = "" if kind == "word" and p["word"].startswith("'") else kind
            at = p.end()


def targets(text: str) -> list[tuple[int, str, bool]]:
    """(start of the value, name, declared with a type) of all assignments, in order."""
    found = {(at, name): typed for name, typed, at in declarations(text) if text[at : at + 1] in ("'", '"', "`") or re.match(rf"[{WORD}]", text[at : at + 1])}
    values = {at for at, _ in found}
    # a plain word before = "literal" is a type, and no value of the name before it
    types = {a for (at, _), a in found.items() if text[at] in "'\"`" and re.compile(r"[A-Za-z]+(?![0-9_.\-])").match(text, a)}
    out = [(at, name, True) for at, name in found]
    for m in TARGET.finditer(text):
        if m.end() not in types and not (m.end() in values and m["run"].lower() in TYPES):
            out.append((m.end(), m["run"], False))
    return sorted(out, key=lambda x: x[0])


def marked_up(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of the values of elements, key and value pairs and indented blocks, a value for each line of a block."""
    out = [(m["run"], *m.span("value")) for p in (ELEMENT, PAIR) for m in p.finditer(text)] if "<" in text or "value" in text else []
    for m in BLOCK.finditer(text) if "|" in text or ">" in text else ():
        out += [(m["run"], x.start(), x.end()) for x in re.compile(r"[^\n]*\S").finditer(text, *m.span("lines"))]
    return [(name, b - len(text[a:b].lstrip()), b) for name, a, b in out]


def enclosed(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of quoted literals in the brackets that a sensitive name opens: elements, arguments, values of names that tell nothing."""
    opened = {m.end() - 1: (m["run"], m["call"]) for m in OPENED.finditer(text) if sensitivity(m["run"]) and not (m["call"] and ASKING.match(m["call"].lower().rpartition(".")[2]))}
    out: list[tuple[str, int, int]] = []
    upto = 0
    for begin in sorted(opened):
        if begin < upto:
            continue
        stack: list[tuple[str | None, bool, str]] = []  # name in force, within a call, bracket
        before, key, held = "open", "", None  # kind of the last token, the name before a sign, a literal that waits for what follows
        for m in INSIDE.finditer(text, begin):
            kind, upto = m.lastgroup, m.end()
            if kind == "note":
                continue
            if held and kind in ("comma", "close"):
                name, call, a, b = held
                if not call or opaque(text[a:b]):
                    out.append((name, a, b))
            held = None
            if kind == "open":
                own = opened.get(m.start())
                around = stack[-1] if stack else (None, False, "")
                passed = before in ("open", "comma") or before == "sets" and key in INNER
                stack.append((own[0], own[1] is not None, m[0]) if own else (around[0] if passed else None, around[1], m[0]))
            elif kind == "close":
                stack.pop()
                if not stack:
                    break
            elif kind in ("triple", "quoted"):
                cut = 3 if kind == "triple" else 1
                name, call, bracket = stack[-1]
                if name and (before == "sets" and key in INNER and not call or before in ("open", "comma")):
                    held = (name, call, m.start() + cut, m.end() - cut)
            if kind in ("quoted", "word"):
                key = m[0].strip("\"'`").lower()
            before = kind
    return out


def indented(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of list elements, and of values of names that tell nothing, on lines below and further in than a sensitive name: alone."""
    if not any(sensitivity(m["run"]) for m in HEADED.finditer(text)):
        return
    stack: list[tuple[int, str | None]] = []
    for m in LINE.finditer(text):
        value = m["value"].strip()
        if not (value or m["run"]):
            continue
        depth = len(m["indent"]) + bool(m["dash"])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        around = stack[-1][1] if stack else None
        inner = not m["run"] or m["run"].lower() in INNER
        if m["run"] and not value:
            stack.append((depth, m["run"] if sensitivity(m["run"]) else around if inner else None))
        elif value and around and inner and (m["run"] or m["dash"]):
            cut = value[0] in "'\"" and value[-1] == value[0] and len(value) > 2
            a = m.start("value") + len(m["value"]) - len(m["value"].lstrip()) + cut
            if cut or value[0] not in "[{(&*!|>" and opaque(value):
                yield around, a, a + len(value) - 2 * cut


class Scopes:
    """The functions of a text, each from its first line to the next line that is indented no further; 0 is what is in none."""

    def __init__(self, text: str):
        self.starts, self.owners, self.parents, stack = [0], [0], [-1], [(-1, 0)]
        heads = {m.start() for m in FUNCTION.finditer(text)}
        for m in re.finditer(r"(?m)^([\x20\t]*+)[^\s})\]]", text) if heads else ():
            while len(stack) > 1 and stack[-1][0] >= len(m[1]):
                stack.pop()
            if m.start() in heads:
                self.parents.append(stack[-1][1])
                stack.append((len(m[1]), len(self.parents) - 1))
            if self.owners[-1] != stack[-1][1]:
                self.starts.append(m.start())
                self.owners.append(stack[-1][1])

    def at(self, place: int) -> int:
        return self.owners[bisect_right(self.starts, place) - 1]


class Constants:
    """What names stand for: items by (scope, name), and under the scope None the latest of any scope."""

    def __init__(self, parents: list[int]):
        self.parents, self.known, self.aliases, self.ends = parents, {}, {}, {}

    def put(self, scope: int, name: str, item: int, other: str | None) -> None:
        """name is an item from here on; other is the name that the item consists of, if it may be one."""
        for key in ((scope, name), (None, name)):
            self.known[key] = item
            self.aliases[key] = (scope, other)

    def key(self, scope: int, name: str | None) -> tuple | None:
        while scope >= 0 and (scope, name) not in self.known:
            scope = self.parents[scope]
        key = (scope if scope >= 0 else None, name)
        return key if key in self.known else None

    def get(self, scope: int, name: str | None) -> int | None:
        return self.known.get(self.key(scope, name))

    def end(self, scope: int, name: str) -> int | None:
        """The item at the end of the chain of names that begins here, None for a circle; every chain is followed once."""
        key, path = self.key(scope, name), []
        while key is not None and key not in self.ends:
            path.append(key)
            self.ends[key] = None
            further = self.key(*self.aliases[key])
            if further is None:
                self.ends[key] = self.known[key]
                break
            key = further
        out = self.ends.get(key)
        self.ends.update((k, out) for k in path)
        return out


def lexed(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of literals that reach a sensitive name, directly, joined or through a constant; and all quoted literals of sensitive names."""
    literals, scopes, spans, quoted, words = Literals(text), Scopes(text), [], [], set()
    constants, waiting = Constants(scopes.parents), []  # sensitive names given a name, which may get a constant later

    def judge(name: str, top: int) -> None:
        if top not in words and literals.scores(name, top):
            spans.extend(literals.take(top))

    def pieces(scope: int, a: int, b: int) -> list[int]:
        """Items of a template from a to b: what stands between its holes, and the constants in them."""
        out, own, missing = [], [], False
        for h in [*HOLE.finditer(text, a, b), None]:
            to = h.start() if h else b
            if a < to and fit(text[a:to]):
                own.append(text[a:to])
                out.append(literals.add((a, to)))
            if h:
                a, found = h.end(), constants.get(scope, h[1])
                missing |= found is None
                out += [] if found is None else [found]
        return [] if missing and not opaque("".join(own)) else out

    for name, a, b in [*marked_up(text), *enclosed(text), *indented(text)]:
        if sensitivity(name):
            judge(name, literals.add((a, b)))
    for at, name, typed in targets(text):
        name = name.lstrip("0123456789.-")
        if not name:
            continue
        scope, parts, others = scopes.at(at), [], []
        while v := VALUE.match(text, at):
            if v["bare"] is None:
                kind = "triple" if v["triple"] else "quoted"
                cut = 3 if v["triple"] else 1
                a, b = v.start(kind) + cut, v.end() - cut
                template = "f" in (v["prefix"] or "").lower() or text[a - 1] == "`"
                parts += pieces(scope, a, b) if template and HOLE.search(text, a, b) else [literals.add((a, b))]
                if sensitivity(name):
                    quoted.append((a, b))
            elif (found := constants.get(scope, v["bare"])) is not None:
                parts.append(found)
            elif typed:
                # languages with types put literals in quotes
                parts = []
                break
            else:
                parts.append(literals.add(v.span()))
                others.append(v["bare"])
                if len(v["bare"]) < 8 and not opaque(v["bare"]):
                    words.add(parts[-1])
            at = v.end()
            if not (more := PLUS.match(text, at)):
                break
            at = more.end()
        if parts:
            top = parts[0] if len(parts) == 1 else literals.add(parts)
            constants.put(scope, name, top, others[0] if others and len(parts) == 1 else None)
            if sensitivity(name):
                judge(name, top)
                waiting += [(scope, name, other) for other in others]
    for scope, name, other in waiting:
        if (found := constants.end(scope, other)) is not None:
            judge(name, found)
    return spans, quoted


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """base and the lexer's spans that lie in no other span."""
    if "=" not in text and ":" not in text and "</" not in text:
        return base
    starts, ends = [], []  # of the base, overlapping spans made one
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def side(a: int, b: int) -> int:
        """How a span lies to the base: 0 apart, 1 overlapping, 2 inside."""
        k = bisect_left(starts, b) - 1
        return 0 if k < 0 or ends[k] <= a else 2 if starts[k] <= a and b <= ends[k] else 1

    found, quoted = lexed(text)
    own = {(a, b) for a, b in found if b > a and side(a, b) < 2} | {(a, b) for a, b in quoted if side(a, b) == 1}
    out, upto = list(base), 0
    for a, b in sorted(own, key=lambda s: (s[0], -s[1])):
        if b > upto:
            out.append((a, 3, b))
            upto = b
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> counts of the base patterns, the digest of the base spans, and all spans."""

    bound_batches(docs.sparkSession)

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["text"]:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                kinds = Counter(k for _, k, _ in base)
                out.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(text, base))))
            yield pd.concat([f[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@F.pandas_udf(StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """Texts with every span replaced by its kind in brackets; overlapping spans become one."""

    def one(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        out, at = [], 0
        for a, k, b in all_spans(text, base_spans(text)):
            if b > at:
                out += [text[at : max(a, at)], f"[{KINDS[k]}]" * (a >= at)]
                at = b
        return "".join([*out, text[at:]]) if at else text

    return texts.map(one)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
