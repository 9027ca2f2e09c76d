"""Graph patterns as text: a lexer and a reader of node and relationship chains, for matching and for lint."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<quoted>`(?:[^`]|``)*`)
    |(?P<number>\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<param>\$\w+)|(?P<mark><>|<=|>=|=~|\.\.|[-<>()\[\]{}:,.|*+/%=;!&$@?^])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int

    @property
    def value(self):
        match self.kind:
            case "string":
                return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.text[1:-1])
            case "number":
                return float(self.text) if re.search(r"[.eE]", self.text) else int(self.text)
            case "quoted":
                return self.text[1:-1].replace("``", "`")
        return self.text


def lex(text: str) -> tuple[list[Token], int | None]:
    """Tokens, and where the text stops being readable."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or (text.startswith("/*", at) and m.lastgroup != "skip"):
            return out, at
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out, None


@dataclass
class NodePattern:
    variable: str | None = None
    labels: tuple[str, ...] = ()
    props: dict[str, Token | None] = field(default_factory=dict)
    readable: bool = True
    start: int = 0


@dataclass
class RelPattern:
    variable: str | None = None
    types: tuple[str, ...] = ()
    direction: str = "any"
    least: int = 1
    most: int | None = 1
    props: dict[str, Token | None] = field(default_factory=dict)
    readable: bool = True
    start: int = 0


class ChainReader:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, *texts: str) -> bool:
        return all(self.at + i < len(self.tokens) and self.tokens[self.at + i].text == t for i, t in enumerate(texts))

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += len(texts)
            return True
        return False

    def name(self) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at].kind in ("word", "quoted"):
            self.at += 1
            return self.tokens[self.at - 1].value
        return None

    def props(self) -> dict[str, Token | None] | None:
        """A map of literals; other values are None. None in all if there is no map or it can't be read."""
        if not self.take("{"):
            return {}
        found: dict[str, Token | None] = {}
        while not self.take("}"):
            key = self.name()
            if key is None or not self.take(":"):
                return None
            depth, first, n = 0, self.at, 0
            while self.at < len(self.tokens) and (depth or not (self.peek(",") or self.peek("}"))):
                depth += self.tokens[self.at].text in "([{"
                depth -= self.tokens[self.at].text in ")]}"
                self.at += 1
                n += 1
            if self.at >= len(self.tokens):
                return None
            literal = self.tokens[first] if n == 1 and (self.tokens[first].kind in ("string", "number") or self.tokens[first].text.lower() in ("true", "false")) else None
            found[key] = literal
            self.take(",")
        return found

    def node(self) -> NodePattern | None:
        start = self.at
        if not self.take("("):
            return None
        out = NodePattern(start=self.tokens[start].start)
        out.variable = self.name()
        labels = []
        while self.take(":") or self.take("&"):
            if self.peek("!") or self.peek("("):
                out.readable = False
                break
            label = self.name()
            if label is None:
                self.at = start
                return None
            labels.append(label)
        if self.peek("|"):
            out.readable = False
        while not out.readable and self.at < len(self.tokens) and not self.peek(")") and not self.peek("{"):
            self.at += 1
        out.labels = tuple(labels)
        props = self.props()
        if props is None or not self.take(")"):
            self.at = start
            return None
        out.props = props
        return out

    def rel(self) -> RelPattern | None:
        start = self.at
        into = self.take("<", "-") or self.take("<", "-", "-")
        if not into and not self.take("-"):
            return None
        out = RelPattern(start=self.tokens[start].start)
        if self.take("["):
            out.variable = self.name()
            if self.take(":"):
                types = [self.name()]
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
                if None in types:
                    out.readable = False
                    types = []
                out.types = tuple(types)
            if self.take("*"):
                out.least, out.most = 1, None
                if self.at < len(self.tokens) and self.tokens[self.at].kind == "number":
                    out.least = out.most = int(self.tokens[self.at].value)
                    self.at += 1
                if self.take(".."):
                    out.most = None
                    if self.at < len(self.tokens) and self.tokens[self.at].kind == "number":
                        out.most = int(self.tokens[self.at].value)
                        self.at += 1
            props = self.props()
            if props is None or not self.take("]"):
                self.at = start
                return None
            out.props = props
            if not self.take("-"):
                self.at = start
                return None
        else:
            self.take("-")
        out_of = self.take(">")
        out.direction = "any" if into == out_of else "in" if into else "out"
        return out

    def chain(self) -> list | None:
        """Nodes and relationships by turns, or None where no node starts."""
        first = self.node()
        if first is None:
            return None
        out: list = [first]
        while True:
            back = self.at
            rel = self.rel()
            node = self.node() if rel else None
            if node is None:
                self.at = back
                return out
            out += [rel, node]


def read_chains(tokens: list[Token]) -> list[list]:
    """All chains in a token list. A bracket right after a word is a call, unless the word is a keyword of a pattern."""
    reader, out = ChainReader(tokens), []
    while reader.at < len(tokens):
        previous = tokens[reader.at - 1] if reader.at else None
        if tokens[reader.at].text == "(" and not (previous and previous.kind == "word" and previous.text.upper() not in ("MATCH", "MERGE", "CREATE", "WHERE", "AND", "OR", "NOT", "XOR", "EXISTS", "IN", "RETURN", "WITH", "OPTIONAL", "ON", "SET", "DELETE", "REMOVE")):
            if found := reader.chain():
                out.append(found)
                continue
        reader.at += 1
    return out


def parse_patterns(text: str) -> list[list]:
    """The chains of a text, which commas part."""
    tokens, broken = lex(text)
    reader, chains, more = ChainReader(tokens), [], broken is None
    while more and (chain := reader.chain()) is not None:
        chains.append(chain)
        more = reader.take(",")
    if more or not chains or reader.at != len(tokens):
        raise ValueError(f"no pattern: {text}")
    return chains


def parse_pattern(text: str) -> list:
    """The one chain that a text is."""
    chains = parse_patterns(text)
    if len(chains) > 1:
        raise ValueError(f"several chains: {text}")
    return chains[0]
