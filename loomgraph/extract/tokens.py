"""The token stream of C, Go and JavaScript files: what stands where, and in which brackets.

A scanner (a regular expression a language that cuts plain code by the stretch, and a step of its own for what depends on
the token before) cuts a file into tokens, which stay columns of numbers. What stands around a token is an index into them: its neighbours, its bracket's mate, the bracket
around it, the head of its chain. Only tokens that a rule can ask for become rows (`sites`), a small share of a file's;
the rules are Spark's, in `token_rules`. Faults of brackets in text of other languages are windows by level.

Known gaps: after `)` or `}` a slash divides; text of JSX elements is read as code; branches of `#if` that
each open a bracket count twice.
"""

from __future__ import annotations

import itertools
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.extract.line_rules import NOT_JS

LANGUAGES = ("c", "go", "js")

_QUOTED = "|".join(rf"{q}(?:[^{q}\\\n]|\\(?s:.))*+{q}?" for q in "\"'")
_GAP = r"(?P<gap>(?:\s++|//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z))++)"
_NAME = r"(?P<name>[A-Za-z_$\x80-\U0010ffff][\w$]*+)|(?P<num>\d[\w.]*+)"
_PATTERN = {
    "c": re.compile(rf"{_GAP}|(?P<str>{_QUOTED})|{_NAME}|(?P<punct>->|\.\.\.|[-+*/%&|^=!<>]=|&&|\|\||(?s:.))"),
    "go": re.compile(rf"{_GAP}|(?P<str>{_QUOTED}|`[^`]*+`?)|{_NAME}|(?P<punct>:=|<-|\.\.\.|[-+*/%&|^=!<>]=|&&|\|\||(?s:.))"),
    "js": re.compile(rf"{_GAP}|(?P<str>{_QUOTED})|{_NAME}|(?P<private>\#[A-Za-z_$][\w$]*+)|(?P<punct>=>|\?\.(?!\d)|\.\.\.|[=!]==?|<=|>=|[-+*/%&|^]=|&&|\|\||\?\?|\+\+|--|(?s:.))"),
}
_DIRECTIVE = re.compile(r"#(?:\\\r?\n|/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*+|[^\n])*+")
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*+")
_CHUNK = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*+(?:`|\$\{)?")
# Words after which an expression begins.
BEFORE_EXPRESSION = ("return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "do", "else", "yield", "await", "instanceof", "default", "extends")
BEFORE_OPERAND = tuple(w for w in BEFORE_EXPRESSION if w not in ("default", "do", "else"))
NO_OPERATOR = (")", "]", "}", "{", ";", "${", "++", "--")
OPEN, CLOSE = ("(", "[", "{", "${"), (")", "]", "}")


#: Stretches of text whose tokens don't depend on what stands before them, some thousand lines or statements at most: in C up to a
#: `#`, in JavaScript up to a slash that begins no comment and a template; _IN_TEMPLATE, in the code between a template's pieces.
_RUN_OF = r"(?:[^{stop}\"'/\n;,]++|[\n;,]|{quoted}|//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z){more}){{0,16384}}+"
_RUN = {
    "c": re.compile(_RUN_OF.format(stop="#", quoted=_QUOTED, more="|/=?")),
    "go": re.compile(_RUN_OF.format(stop="`", quoted=_QUOTED, more="|`[^`]*+`?|/=?")),
    "js": re.compile(_RUN_OF.format(stop="`", quoted=_QUOTED, more="")),
}
_IN_TEMPLATE = re.compile(_RUN_OF.format(stop="`{}", quoted=_QUOTED, more=""))
_WHOLE = {lang: re.compile(re.sub(r"\?P<\w+>", "?:", p.pattern)) for lang, p in _PATTERN.items()}


class Numbers(dict):
    """Numbers of texts, and the texts, in the order of their first sight."""

    def __init__(self) -> None:
        self.texts: list[str] = []

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self.texts)
        self.texts.append(text)
        return n


class Pieces:
    """A text cut up whole, also what stands between tokens, a block at a time. A template literal is a token for each of its
    pieces, and `${` and `}` around the code between them. Stretches of plain code are cut by one call each."""

    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang = text, lang
        self.tail: list[tuple[str, str]] = []  # of all blocks before the gap at their end and the last token, as _last has them
        self._begin()

    def _begin(self) -> None:
        self.numbers, self.ids, self.kinds = Numbers(), array("i"), {}

    def blocks(self, size: int) -> Iterator[tuple[list[str], array, dict[int, str], bool]]:
        """Of `size` pieces or some more at a time: their texts, the number of each piece's text, the kinds of those whose
        kind their text alone doesn't tell, and whether it is the last block."""
        text, lang = self.text, self.lang
        match, whole = _PATTERN[lang].match, _WHOLE[lang].findall
        at, n = 0, len(text)
        templates: list[int] = []  # of each open one how many braces are open in its code
        pending = ""  # the begin of a template's piece that is to be read next
        while at < n or pending:
            if len(self.ids) >= size:
                yield self._take(False)
            if pending:
                end = _CHUNK.match(text, at + len(pending) - 1).end()
                code = text.endswith("${", at, end) and not text.endswith("\\${", at, end)
                end -= 2 if code else 0
                self._add(text[at:end], "str")
                at, pending = end, ""
                if code:
                    self._add("${", "punct")
                    templates.append(0)
                    at += 2
                continue
            end = (_IN_TEMPLATE if templates else _RUN[lang]).match(text, at).end()
            if end > at:
                self.ids.extend(map(self.numbers.__getitem__, whole(text, at, end)))
                at = end
                continue
            m = match(text, at)
            piece, kind, end = m[0], m.lastgroup, m.end()
            if lang == "c":
                if piece == "#" and self._fresh():
                    kind, end = "directive", _DIRECTIVE.match(text, at).end()
            elif lang == "js" and kind == "punct":
                if piece == "`":
                    pending = "-`"
                    continue
                if piece in ("/", "/=") and self._operand() and (r := _REGEX.match(text, at)):
                    kind, end = "regex", r.end()
                elif piece == "}" and templates and not templates[-1]:
                    templates.pop()
                    pending = "-"
                elif templates and piece in "{}":
                    templates[-1] += 1 if piece == "{" else -1
            self._add(text[at:end], kind)
            at = end
        yield self._take(True)

    def _take(self, is_last: bool) -> tuple[list[str], array, dict[int, str], bool]:
        """The block so far, which is then held here no longer."""
        block = self.numbers.texts, self.ids, self.kinds, is_last
        self.tail = self._end()
        self._begin()
        return block

    def _add(self, piece: str, kind: str) -> None:
        self.kinds[len(self.ids)] = kind
        self.ids.append(self.numbers[piece])

    def _last(self) -> Iterator[tuple[str, str]]:
        """(text, kind) of the pieces so far, the last first; of blocks before their last token only."""
        for j in range(len(self.ids) - 1, -1, -1):
            piece = self.numbers.texts[self.ids[j]]
            yield piece, self.kinds.get(j) or _PATTERN[self.lang].match(piece).lastgroup
        yield from self.tail

    def _end(self) -> list[tuple[str, str]]:
        gap = ""
        for piece, kind in self._last():
            if kind != "gap":
                return [(gap, "gap"), (piece, kind)]
            gap = "\n" if "\n" in piece else gap
        return [(gap, "gap")]

    def _fresh(self) -> bool:
        """Whether the next token is the first one of its line."""
        for piece, kind in self._last():
            if kind != "gap":
                return False
            if "\n" in piece:
                return True
        return True

    def _operand(self) -> bool:
        """Whether a slash begins an operand."""
        last, kind = next((x for x in self._last() if x[1] != "gap"), ("", ""))
        return kind in ("", "punct") and last not in (*CLOSE, "++", "--") or last in BEFORE_EXPRESSION


def scan(text: str, lang: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, text, gap) of the tokens; gap is what stands between a token and the one before."""
    placed, out, before = Placed(text, lang), [], 0
    for line, kind, begin, end in zip(placed.line.tolist(), placed.kind.tolist(), placed.begin.tolist(), placed.end.tolist(), strict=True):
        out.append((line, KINDS[kind], text[begin:end], text[before:begin]))
        before = end
    return out


KINDS = ("punct", "name", "num", "str", "private", "regex", "directive")
_WANTS = {"(": ")", "[": "]", "{": "}", "${": "}"}


class Placed:
    """A file's tokens as arrays: k (their place in the file), line, kind, word (a number in `words`), begin, end, mate and around
    (the brackets' indices, -1 for none); and the first fault of its brackets, (line, found, expected), or None.

    Or a block of them, behind those of the blocks before, `was`, that later ones still ask for: open brackets, what stands by them,
    and the last few tokens. Those are the first `old`, and keep what was found of them when they were new."""

    def __init__(self, text: str, lang: str, block: tuple[list[str], array, dict[int, str], bool] | None = None, was: Placed | None = None) -> None:
        self.text, self.lang, self.was = text, lang, was
        texts, pieces, given, self.is_last = block or next(Pieces(text, lang).blocks(sys.maxsize))
        ids = np.frombuffer(pieces, "i4") if pieces else np.zeros(0, "i4")
        self.kept = was.still_asked_for() if was else np.zeros(0, "i8")
        self.old = len(self.kept)
        lines_before, at, n_before = (was.next_line, was.next_at, was.next_k) if was else (1, 0, 0)
        match, kinds = _PATTERN[lang].match, {k: j for j, k in enumerate(KINDS)} | {"gap": -1}
        of = lambda f, t: np.fromiter(map(f, texts), t, len(texts))[ids]
        kind = of(lambda w: kinds[m.lastgroup] if (m := match(w)) else -1, "i1")
        kind[list(given)] = [kinds[k] for k in given.values()]
        lines, end = of(lambda w: w.count("\n"), "i4"), np.cumsum(of(len, "i4"), dtype="i4") + np.int32(at)
        token = kind >= 0
        line = np.cumsum(lines, dtype="i4") - lines + np.int32(lines_before)
        begin = np.concatenate([[at], end[:-1]]).astype("i4")[: len(ids)]
        self.next_line, self.next_at = lines_before + int(lines.sum()), int(end[-1]) if len(ids) else at
        used = np.zeros(len(texts), bool)
        used[ids[token]] = True
        word = (np.cumsum(used, dtype="i4") - 1)[ids[token]]
        self.numbers = {w: j for j, w in enumerate(itertools.compress(texts, used.tolist()))}
        self.next_k = n_before + len(word)
        self.line, self.kind = self._behind("line", line[token]), self._behind("kind", kind[token])
        self.begin, self.end = self._behind("begin", begin[token]), self._behind("end", end[token])
        del ids, pieces, block, kind, lines, line, begin, end, token
        self.k = self._behind("k", np.arange(n_before, self.next_k, dtype="i4"))
        self.word = np.concatenate([self._renumbered("word"), word])
        self.old_heads = self._renumbered("head_word") if was and lang == "js" else None
        self.words, self.n = pa.array(list(self.numbers), pa.string()), len(self.word)
        self.every = np.arange(self.n, dtype="i4") if self.old else self.k
        self.settled = self._behind("settled", np.zeros(len(word), bool))
        none = np.array([-1], "i1")
        self._words, self._kinds = np.append(self.word, none), np.append(self.kind, none)  # index -1, no token, has neither
        self.word, self.kind = self._words[:-1], self._kinds[:-1]
        self._match()

    def _of_old(self, name: str) -> np.ndarray:
        return getattr(self.was, name)[self.kept] if self.was else np.zeros(0, "i4")

    def _behind(self, name: str, new: np.ndarray) -> np.ndarray:
        return np.concatenate([self._of_old(name), new]).astype(new.dtype) if self.old else new

    def _renumbered(self, name: str) -> np.ndarray:
        """Numbers in `words` of the blocks before, as numbers in this one's."""
        old = self._of_old(name)
        texts = self.was.words.take(pa.array(old, pa.int32())).to_pylist() if self.old else []
        return np.array([self.numbers.setdefault(t, len(self.numbers)) for t in texts], "i4")

    def _match(self) -> None:
        """mate, around, fault and unclosed. Brackets of one level, the depth between one and its mate, alternate."""
        self.mate, self.around, self.fault = np.full(self.n, -1, "i4"), np.full(self.n, -1, "i4"), self.was.fault if self.was else None
        self.unclosed, self.depth = np.zeros(self.n, bool), 0
        opens, closes = self.punct(self.every, *OPEN), self.punct(self.every, *CLOSE)
        counts = opens | closes
        if self.was:
            counts[: self.old] = self._of_old("unclosed")
            now = np.full(self.was.n + 2, -2, "i4")  # where tokens are now: -2 for those that went, and what they held
            now[self.kept], now[-1] = np.arange(self.old), -1
            self.depth = self.was.depth - int(counts[: self.old].sum())
        b = np.flatnonzero(counts).astype("i4")
        if len(b):
            self._match_brackets(b, opens, counts)
        if self.was:
            self.around[: self.old] = now[self._of_old("around")]
            mate = now[self._of_old("mate")]
            self.mate[: self.old] = np.where(mate >= 0, mate, self.mate[: self.old])

    def _match_brackets(self, b: np.ndarray, opens: np.ndarray, counts: np.ndarray) -> None:
        up = opens[b]
        depth = np.cumsum(2 * up.astype("i1") - 1, dtype="i4") + np.int32(self.depth)
        self.depth = int(depth[-1])
        level = np.where(up, depth, depth + 1)
        order = np.argsort(level, kind="stable")
        pairs = up[order][:-1] & (level[order][1:] == level[order][:-1])
        o, c = order[:-1][pairs], order[1:][pairs]
        self.mate[b[o]] = b[c]
        self.unclosed[b] = up & (self.mate[b] < 0)
        # the bracket around one is the last before it that opens the level below
        size, places = len(b) + 1, np.flatnonzero(up)
        keys = level[places].astype("i8") * size + places
        by_key = np.argsort(keys)
        outer = by_key[np.searchsorted(keys[by_key], (level.astype("i8") - 1) * size + np.arange(len(b))) - 1] if len(places) else np.zeros(len(b), "i8")
        outside = np.where(level > 1, b[places[outer]] if len(places) else -1, -1)
        inside = np.where(up, np.where(depth > 0, b, -1), outside)
        last = np.cumsum(counts, dtype="i4") - 1
        self.around[:] = np.where(last >= 0, inside[last], -1)
        self.around[b] = outside

        if self.fault is not None:
            return
        wants = np.select([self.has(b, "(", ")"), self.has(b, "[", "]")], [0, 1], 2)
        opener = np.full(len(b), -1)
        opener[c] = o
        wrong = np.flatnonzero(~up & ((level < 1) | (wants != wants[opener])))
        line = lambda j: int(self.line[b[j]])
        text = lambda j: self.text[self.begin[b[j]] : self.end[b[j]]]
        if len(wrong):
            j = wrong[0]
            self.fault = line(j), text(j), _WANTS[text(opener[j])] if level[j] > 0 else None
        elif self.is_last and depth[-1] > 0:
            j = np.flatnonzero(up & (level == 1))[-1]
            self.fault = line(j), text(j), _WANTS[text(j)]

    def still_asked_for(self) -> np.ndarray:
        """The indices of what blocks behind ask for: open brackets, and one that the last token closes, with the call before
        it and what stands around that; where such a call's other bracket ends; the last few tokens; and what tells a class's body."""
        keep = np.zeros(self.n, bool)
        keep[-6:] = True
        keep[self.mark[-1:][self.mark[-1:] >= 0]] = True
        o = np.flatnonzero(self.unclosed | (self.mate == self.n - 1))
        for j in range(-5, 2):
            x = self.off(o, j)
            keep[x[(x >= 0) & (self.k[x] - self.k[o] == j)]] = True
        open_calls = np.flatnonzero(~self.settled)
        for j in (1, 2):
            for x in (self.at(self.mate, self.off(open_calls, j)), self.beyond(self.off(open_calls, j))):
                keep[x[x >= 0]] = True
        return np.flatnonzero(keep)

    def off(self, i: np.ndarray, j: int) -> np.ndarray:
        """The indices j tokens further, -1 where there is none."""
        return np.where((i >= 0) & (i + j >= 0) & (i + j < self.n), i + j, -1)

    def at(self, values: np.ndarray, i: np.ndarray, none: object = -1) -> np.ndarray:
        return np.where(i >= 0, values[i], none) if self.n else np.zeros(0, values.dtype)

    def beyond(self, i: np.ndarray, j: int = 1) -> np.ndarray:
        """The j-th token behind the mate of each."""
        return self.off(self.at(self.mate, i), j)

    def has(self, i: np.ndarray, *texts: str) -> np.ndarray:
        known = np.zeros(len(self.words) + 1, bool)  # the last is that of no token
        known[[self.numbers[t] for t in texts if t in self.numbers]] = True
        return known[self._words[i]]

    def is_kind(self, i: np.ndarray, *kinds: str) -> np.ndarray:
        known = np.zeros(len(KINDS) + 1, bool)
        known[[KINDS.index(k) for k in kinds]] = True
        return known[self._kinds[i]]

    def punct(self, i: np.ndarray, *texts: str) -> np.ndarray:
        return self.is_kind(i, "punct") & self.has(i, *texts)

    def in_expression(self, i: np.ndarray) -> np.ndarray:
        """`in_expression` of Spark's columns, of the tokens with these indices."""
        operator = self.is_kind(i, "punct") & ~self.has(i, *NO_OPERATOR)
        return operator | self.is_kind(i, "name") & self.has(i, *BEFORE_OPERAND)

    def braces(self) -> None:
        """brace, what kind of bracket each opens, and class_at: of the body of a class its word `class`."""
        i, before, opens = self.every, self.off(self.every, -1), self.punct(self.every, *OPEN)
        # the last word `class` before a brace with no brace or semicolon between makes it a class's body
        is_class = (self.lang == "js") & self.has(i, "class") & self.is_kind(i, "name") & ~self.has(before, ".", "?.")
        is_class[: self.old] = self._of_old("is_class")
        self.mark, self.is_class = np.maximum.accumulate(np.where(is_class | self.punct(i, "{", "}", ";", "${"), i, -1)) if self.n else i, is_class
        head = self.at(self.mark, before)
        is_brace = self.punct(i, "{")
        in_class = is_brace & (head >= 0) & is_class[head]
        self.class_at = np.where(in_class, head, -1)
        kinds = [in_class, is_brace & self.has(before, "interface"), is_brace & self.is_kind(before, "str"), is_brace & self.in_expression(before) & ~self.has(before, "=>"), *(self.punct(i, o) for o in OPEN)]
        self.brace = np.select(kinds, list(np.arange(1, len(kinds) + 1, dtype="i1")), np.int8(0)) * opens
        self.brace[: self.old] = self._of_old("brace")

    def by_bracket(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' order by the bracket around them, and whether one is its bracket's first."""
        order = np.argsort(self.around, kind="stable").astype("i4")
        first = np.ones(self.n, bool)
        first[1:] = self.around[order][1:] != self.around[order][:-1]
        return order, first

    def chains(self) -> None:
        """Of each token the head of its chain, as `a` in `a.b(c).d`, by head_word, head_line and head_begin; and opened, how many
        parentheses the chain opened before it. Links of a chain are neighbours within the bracket around them, however much
        its brackets hold; the last one within each open bracket is among the old tokens."""
        i = self.every
        order, first = self.by_bracket()
        near = np.full(self.n, -1)
        near[order[1:]] = np.where(first[1:], -1, order[:-1])
        punct = self.is_kind(i, "punct")
        word = self.has(near, *NOT_JS, *BEFORE_EXPRESSION) & ~self.has(self.off(i, -2), ".", "?.")
        value = self.is_kind(near, "name", "private", "str", "regex") & ~word | self.has(near, ")", "]", "?.")
        link = punct & self.has(i, ".", "?.", ")", "]", "}", "${") | self.has(near, ".", "?.", "new") | punct & self.has(i, "(", "[") & value
        link |= self.is_kind(i, "str") & (value | self.has(near, "}", "${"))
        link[: self.old] = False
        place = np.maximum.accumulate(np.where(first | ~link[order], i, -1)) if self.n else i
        parens = np.cumsum(punct[order] & self.has(order, "(")) - (punct[order] & self.has(order, "("))
        head, self.opened = np.zeros(self.n, "i8"), np.zeros(self.n, "i4")
        head[order], self.opened[order] = order[place], parens - parens[place]
        heads = {"head_word": self.word, "head_line": self.line, "head_begin": self.begin}
        if self.old:
            self.opened += np.append(self._of_old("opened"), np.zeros(self.n - self.old, "i4"))[head]
            heads = {c: np.append(self.old_heads if c == "head_word" else self._of_old(c), x[self.old :]) for c, x in heads.items()}
        self.head_word, self.head_line, self.head_begin = (x[head] for x in heads.values())

    def calls(self) -> np.ndarray:
        """Names that a parenthesis follows: those of which all is known that is asked for. Others stay unsettled."""
        i, n1, n2 = self.every, self.off(self.every, 1), self.off(self.every, 2)
        found = self.is_kind(i, "name") & (self.has(n1, "(") | self.has(n1, "?.") & self.has(n2, "(")) & ~self.settled
        self.settled[:] = True
        if not self.is_last:
            opens, late = self.punct(i, *OPEN), lambda x: (x < 0) | opens[x] & (self.beyond(x) < 0)
            known = found & ~late(n1) & ~late(n2)
            self.settled[found & ~known] = False
            self.settled[-2:] = False
            found = known
        return np.flatnonzero(found)

    def definitions(self) -> np.ndarray:
        """What the rules of definitions ask for: names before what may define them, bodies of classes, and of the brackets
        around arrows, C's bodies and Go's functions the tokens at which a statement or expression begins or ends."""
        i, n1, p1 = self.every, self.off(self.every, 1), self.off(self.every, -1)
        if self.lang == "go":
            return np.flatnonzero((self.around < 0) & (self.is_kind(i, "name") & self.has(i, "func") | self.punct(i, "{")))
        name = self.is_kind(i, "name")
        body = name & self.has(n1, "(") & self.has(self.beyond(n1), "{")
        order, first = self.by_bracket()
        if self.lang == "c":
            breaks = self.punct(i, ";", "}") | self.is_kind(i, "directive")
            starts = np.zeros(self.n, bool)
            starts[order] = first | np.concatenate([[False], breaks[order][:-1]])[: self.n]
            return np.flatnonzero(body | np.isin(self.around, self.around[body]) & (breaks | starts))
        arrow = self.punct(i, "=>")
        last = np.zeros(self.n, bool)
        last[order] = np.append(first[1:], True)[: self.n]
        breaks = self.punct(i, ",", ";") | name & self.has(i, "const", "let", "var") | (self.line > self.at(self.line, p1, 1 << 30)) | name & self.has(n1, "=")
        return np.flatnonzero(body | (self.class_at >= 0) | np.isin(self.around, self.around[arrow]) & (arrow | last | breaks))

    def rows(self, path: str, what: str) -> Iterator[pa.RecordBatch]:
        """SITE rows for `what`, calls or definitions."""
        self.braces()
        sites, chained = getattr(self, what)(), what == "calls" and self.lang == "js"
        if chained:
            self.chains()
        self.was = None
        for at in range(0, len(sites), ROWS):
            yield self._batch(path, sites[at : at + ROWS], chained, what == "calls")

    def _batch(self, path: str, i: np.ndarray, chained: bool, brief: bool) -> pa.RecordBatch:
        """brief: without what the rules of calls never ask for."""
        none = lambda t: pa.nulls(len(i), t)
        text = lambda x: self.words.take(pa.array(self.at(self.word, x), pa.int32(), mask=x < 0))
        kind = lambda x: _KIND_NAMES.take(pa.array(self.at(self.kind, x), pa.int32(), mask=x < 0))
        number = lambda values, x: pa.array(self.at(values, x), pa.int32(), mask=x < 0)
        closes = lambda x: number(self.line, self.at(self.mate, x))
        struct = lambda x, **columns: pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=pa.array(x < 0))

        def behind(x: np.ndarray) -> dict:
            b = self.beyond(x)
            if brief:
                return {"text": text(x), "kind": none(pa.string()), "close_line": closes(x), "after": text(b), "after_kind": none(pa.string()), "after2": none(pa.string()), "after_close_line": none(pa.int32())}
            return {"text": text(x), "kind": kind(x), "close_line": closes(x), "after": text(b), "after_kind": kind(b), "after2": text(self.beyond(x, 2)), "after_close_line": closes(b)}

        around, word = self.around[i], self.class_at[i]
        named = self.off(word, 1)
        named = np.where((word >= 0) & self.is_kind(named, "name") & ~self.has(named, "extends") & ~self.in_expression(self.off(word, -1)), named, -1)
        columns = {"path": pa.array([path] * len(i), pa.string()), "lang": pa.array([self.lang] * len(i), pa.string()), "k": pa.array(self.k[i], pa.int32()), "line": number(self.line, i), "kind": kind(i), "text": text(i), "is_punct": pa.array(self.is_kind(i, "punct")), "close_k": number(self.k, self.mate[i]), "close_line": closes(i)}
        for j in (1, 2, 3):
            x = self.off(i, -j)
            columns[f"p{j}"] = struct(x, text=text(x), kind=kind(x), line=number(self.line, x))
        for j in (1, 2):
            x = self.off(i, j)
            columns[f"n{j}"] = struct(x, **behind(x))
        for j in (3, 4):
            x = self.off(i, j)
            columns[f"n{j}"] = none(_FAR) if brief else struct(x, text=text(x), kind=kind(x), after=text(self.beyond(x)))
        columns["class_name"] = text(named)
        columns["encl"] = pa.StructArray.from_arrays([pa.array(self.at(self.k, around), pa.int32()), _BRACES.take(pa.array(self.at(self.brace, around, 0), pa.int32()))], ["k", "brace"])
        head = {"text": self.words.take(pa.array(self.head_word[i], pa.int32())), "line": pa.array(self.head_line[i], pa.int32())} if chained else {"text": none(pa.string()), "line": none(pa.int32())}
        columns["head"] = struct(i if chained else np.full(len(i), -1), **head)
        columns["opened"] = pa.array(self.opened[i] if chained else np.zeros(len(i), "i4"), pa.int32())
        of = i - 2 if chained else np.full(len(i), -1)
        of = np.where(self.has(self.off(i, -1), ".", "?."), of, -1)
        begin = self.head_begin[i] if chained else of
        columns["object"] = pa.array([self.text[a : self.end[b]] if b >= 0 else None for a, b in zip(begin.tolist(), of.tolist(), strict=True)], pa.string())
        columns["expected"] = pa.nulls(len(i), pa.string())
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in SITE], schema=SITE)


# What brace holds, by its number, and the kinds' names
_BRACES = pa.array(["", "class", "interface", "linkage", "object", *OPEN])
_KIND_NAMES = pa.array(KINDS)
_ME = pa.struct([("text", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
_IT = pa.struct([("text", pa.string()), ("kind", pa.string()), ("close_line", pa.int32()), ("after", pa.string()), ("after_kind", pa.string()), ("after2", pa.string()), ("after_close_line", pa.int32())])
_FAR = pa.struct([("text", pa.string()), ("kind", pa.string()), ("after", pa.string())])
#: A site: a token with close_k and close_line, where its bracket's mate is; p1..p3 and n1..n4, the tokens before and
#: after, of those after also what stands behind their mate; class_name, of a class's body; encl, the bracket around;
#: of calls in JavaScript head and opened, of its chain, and object, its text before the last dot. A row of kind
#: `fault` is a file's first fault of brackets: text is what was found.
SITE = pa.schema([("path", pa.string()), ("lang", pa.string()), ("k", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("is_punct", pa.bool_()), ("close_k", pa.int32()), ("close_line", pa.int32())]
    + [(f"p{j}", _ME) for j in (1, 2, 3)] + [("n1", _IT), ("n2", _IT), ("n3", _FAR), ("n4", _FAR), ("class_name", pa.string()), ("encl", pa.struct([("k", pa.int32()), ("brace", pa.string())])), ("head", pa.struct([("text", pa.string()), ("line", pa.int32())])), ("opened", pa.int32()), ("object", pa.string()), ("expected", pa.string())])
_STRUCT = {_ME: "struct<text: string, kind: string, line: int>", _IT: "struct<text: string, kind: string, close_line: int, after: string, after_kind: string, after2: string, after_close_line: int>", _FAR: "struct<text: string, kind: string, after: string>"}
SITE_TYPE = ", ".join(f"{f.name} " + {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}.get(f.type, _STRUCT.get(f.type, "struct<k: int, brace: string>" if f.name == "encl" else "struct<text: string, line: int>")) for f in SITE)
#: Rows that a task holds at once, whatever the length of a file; and for calls pieces of its text, or some more.
ROWS, BLOCK = 1 << 14, 1 << 17


def blocks(text: str, lang: str, what: str) -> Iterator[Placed]:
    """A file's tokens, for calls a block at a time: a call asks for what stands by it and by the end of its brackets."""
    placed = None
    for block in Pieces(text, lang).blocks(BLOCK if what == "calls" else sys.maxsize):
        placed = Placed(text, lang, block, placed)
        del block
        yield placed


def _sites(what: str) -> Callable:
    def joined(some: list[pa.RecordBatch], faults: list[dict]) -> pa.RecordBatch:
        some = [*some, pa.RecordBatch.from_pylist(faults, SITE)] if faults else some
        return some[0] if len(some) == 1 else pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        faults: list[dict] = []
        held = 0
        for batch in batches:
            for j in range(batch.num_rows):
                path, lang = batch.column(0)[j].as_py(), batch.column(1)[j].as_py()
                if not batch.column(2)[j].is_valid:
                    continue
                for placed in blocks(batch.column(2)[j].as_py(), lang, what):
                    for rows in placed.rows(path, what):
                        some.append(rows)
                        held += rows.num_rows
                        if held >= ROWS:
                            yield joined(some, faults)
                            some, faults, held = [], [], 0
                if placed.fault is not None:
                    line, found, expected = placed.fault
                    faults.append({"path": path, "lang": lang, "k": -1, "line": line, "kind": "fault", "text": found, "is_punct": False, "expected": expected})
                    held += 1
                if held >= ROWS:
                    yield joined(some, faults)
                    some, faults, held = [], [], 0
        if held:
            yield joined(some, faults)

    return run


def sites(files: DataFrame, what: str) -> DataFrame:
    """SITE rows of files (path, content, lang) in one of LANGUAGES, for the rules of `what`, calls or definitions."""
    # files without content are left out by the tasks: a test here would make what content is made of be computed twice
    d = files.where(F.col("lang").isin(*LANGUAGES)).select("path", "lang", "content")
    # dealt anew: a few long files that compress well lie in few partitions
    return d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism).mapInArrow(_sites(what), SITE_TYPE)


def with_depth(brackets: DataFrame) -> DataFrame:
    """Rows (path, k, text, ...) with opens, closes and level: the depth between a bracket and its mate, which for
    other rows is null; and outer: the depth around a row."""
    by_path = Window.partitionBy("path").orderBy("k")
    d = brackets.withColumn("opens", F.col("is_punct") & F.col("text").isin(*OPEN)).withColumn("closes", F.col("is_punct") & F.col("text").isin(*CLOSE))
    d = d.withColumn("depth", F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(by_path))
    level = F.when(F.col("opens"), F.col("depth")).when(F.col("closes"), F.col("depth") + 1)
    return d.withColumn("level", level).withColumn("outer", F.when(F.col("opens"), F.col("depth") - 1).otherwise(F.col("depth"))).drop("depth")


def faults(brackets: DataFrame) -> DataFrame:
    """(path, line, found, expected): of each file (path, k, line, text, is_punct) the first bracket that closes
    nothing or another kind, or else the first that nothing closes. Up to the first fault brackets of one level
    alternate, so what a bracket closes is its neighbour there."""
    d = with_depth(brackets.where(F.col("is_punct") & F.col("text").isin(*OPEN, *CLOSE)))
    by_level = Window.partitionBy("path", "level").orderBy("k")
    d = d.withColumn("mate", F.when(F.col("opens"), F.lead("text").over(by_level)).otherwise(F.lag("text").over(by_level)))
    wants = F.when(F.col("text") == "(", ")").when(F.col("text") == "[", "]").when(F.col("opens"), "}")
    mate_wants = F.when(F.col("mate") == "(", ")").when(F.col("mate") == "[", "]").when(F.col("mate").isin("{", "${"), "}")
    wrong = F.col("closes") & ((F.col("level") < 1) | ~F.coalesce(mate_wants == F.col("text"), F.lit(False)))
    never = F.col("opens") & F.col("mate").isNull()
    d = d.where(wrong | never)
    order = F.struct(F.when(F.col("closes"), 0).otherwise(1), "k")
    found = F.struct("line", F.col("text").alias("found"), F.when(F.col("closes"), F.when(F.col("level") >= 1, mate_wants)).otherwise(wants).alias("expected"))
    return d.groupBy("path").agg(F.min_by(found, order).alias("x")).select("path", "x.*")


def fault_text(found: DataFrame) -> DataFrame:
    """(path, error) of faults."""
    wanted = F.coalesce(F.concat(F.col("expected"), F.lit(" expected")), F.lit("nothing is open"))
    return found.select("path", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("found"), F.lit(", "), wanted).alias("error"))


def in_expression(before: Column) -> Column:
    """Whether what follows the token `before` is an operand and not a statement of its own."""
    operator = (before["kind"] == "punct") & ~before["text"].isin(*NO_OPERATOR)
    return F.coalesce(operator | ((before["kind"] == "name") & before["text"].isin(*BEFORE_OPERAND)), F.lit(False))
