"""Formulas in the form that a browser can show: a table of rules by command, read off in one pass over balanced groups.

A rule says how many groups a command takes and what becomes of them; `#1` stands for the first. Groups are rewritten before
they are filled in. Commands whose groups are missing or don't close stay as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """groups: braces that a command takes; becomes: what it is replaced by; token: whether a letter or digit stands for a group; options: whether brackets before a group are passed over; eats: whether blanks after the last group go."""

    groups: int
    becomes: str | Callable[[list[str]], str]
    token: bool = False
    options: bool = False
    eats: bool = False
    between: str = ""


def _text_or_math(groups: list[str]) -> str:
    """A box of text within a formula: text in \\text, what dollar signs enclose as it is."""
    pieces = re.split(r"(?<!\\)\$", groups[0])
    return "".join(x if k % 2 else rf"\text{{{x}}}" for k, x in enumerate(pieces) if x)


def _bare(groups: list[str]) -> str:
    """A raised box's content without dollar signs around it."""
    inside = groups[-1].strip()
    return inside[1:-1] if len(inside) > 1 and inside[0] == inside[-1] == "$" else inside


# Fonts by their old names (in text, in math), environments and what stands for them, commands and what stands for them.
FONTS = {"bf": ("textbf", "mathbf"), "it": ("textit", "mathit"), "rm": ("textrm", "mathrm"), "sf": ("textsf", "mathsf"), "sl": ("textit", "mathit"), "tt": ("texttt", "mathtt")}
ALIGNED, UNMARKED = ("split", "eqnarray", "eqnarray*", "IEEEeqnarray", "IEEEeqnarray*"), ("equation", "equation*")
MATRICES = ("matrix", "pmatrix", "bmatrix", "vmatrix", "Vmatrix", "Bmatrix", "smallmatrix")
BLACKBOARD = ("vvmathbb", "varmathbb", "vmathbb", "mathbbmss", "mathbbmtt", "mathbbm", "mathds", "mathbbold")
GONE = ("displaystyle", "strut", "xspace", "protect", "hfill", "dotfill", "hrulefill")
BREAKS = ("pagebreak", "nopagebreak", "linebreak", "break")
REFERENCES = ("label", "vref", "pageref", "autoref", "cref", "Cref")
LINES = ("cline", "cmidrule")
BIG = [size + side for size in ("big", "Big", "bigg", "Bigg") for side in ("", "l", "r", "m")]

_OLD_FONT = re.compile(rf"\\({'|'.join(FONTS)})\s+([^{{}}]+)")
_DELIMITER = re.compile(r"\\?[{}()\[\]|.]")


def _font(body: str, of: int) -> str | None:
    """A group that begins with an old font command, under the new one's name; None for other groups."""
    found = _OLD_FONT.fullmatch(body)
    return rf"\{FONTS[found[1]][of]}{{{found[2].strip()}}}" if found else None


def _sized(name: str) -> Callable[[list[str]], str]:
    return lambda g: rf"\{name}{g[0].strip()}" if _DELIMITER.fullmatch(g[0].strip()) else rf"\{name}{{{g[0]}}}"


RULES: dict[str, Rule] = {
    **{c: Rule(1, r"\mathbb{#1}", token=True, eats=True) for c in BLACKBOARD},
    "wideparen": Rule(1, r"\overset{\frown}{#1}", eats=True),
    "cancelto": Rule(2, r"\overset{#1}{#2}", eats=True),
    **{c: Rule(1, "#1", eats=True) for c in ("ensuremath", "mathlarger", "mathsmaller")},
    **{c: Rule(2, "#2", eats=True) for c in ("rotatebox", "scalebox")},
    **{c: Rule(3, "#3", eats=True) for c in ("resizebox", "multicolumn")},
    "pmatrix": Rule(1, r"\begin{pmatrix}#1\end{pmatrix}"),
    "textsc": Rule(1, lambda g: rf"\text{{{g[0].upper()}}}"),
    "mbox": Rule(1, _text_or_math),
    "raisebox": Rule(2, _bare, options=True),
    "text": Rule(1, lambda g: _font(g[0].strip(), 0) or rf"\text{{{g[0]}}}"),
    "buildrel": Rule(2, r"\overset{#1}{#2}", between=r"\over"),
    "expectationvalue": Rule(1, r"\left\langle #1 \right\rangle"),
    "eqref": Rule(1, r"(\text{?})"),
    "ref": Rule(1, r"\text{?}"),
    "mspace": Rule(1, ""),
    **{c: Rule(1, "") for c in REFERENCES},
    **{c: Rule(1, "", options=True) for c in LINES},
    **{c: Rule(1, _sized(c)) for c in BIG},
    **{c: Rule(0, "") for c in GONE},
    **{c: Rule(0, "", options=True) for c in BREAKS},
    "coloneqq": Rule(0, ":="),
    "eqqcolon": Rule(0, r"\mathrel{=:}"),
    "iddots": Rule(0, r"\ddots"),
    "vline": Rule(0, "|"),
    "cr": Rule(0, r"\\"),
}
_COMMAND = re.compile(r"\\(?:([A-Za-z]+)|(?s:.)|$)")
_PLAIN = re.compile(r"[^\\{}]+")
_OPTION = re.compile(r"\s*\[[^\]]*\]")
_TOKEN = re.compile(r"\s+([A-Za-z0-9])")
_SPACE = re.compile(r"\s*")


@dataclass
class _Open:
    """What is open: a group (name is None), or a command that waits for its next group."""

    name: str | None = None
    rule: Rule | None = None
    raw: str = ""
    groups: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)


def _filled(rule: Rule, groups: list[str]) -> str:
    if callable(rule.becomes):
        return rule.becomes(groups)
    return re.sub(r"#(\d)", lambda m: groups[int(m[1]) - 1], rule.becomes)


def _environment(tex: str, at: int, name: str) -> tuple[str, int] | None:
    """What stands for a \\begin or \\end at the brace `at`, and where it ends; None where nothing is named."""
    found = re.compile(r"\{([A-Za-z]+\*?)\}").match(tex, at)
    if not found:
        return None
    kind, end = found[1], found.end()
    if kind in UNMARKED:
        return "", end
    if name == "begin" and kind in MATRICES and (option := re.compile(r"\s*\[[^\]]+\]").match(tex, end)):
        end = option.end()
    if name == "begin" and kind == "array" and (option := re.compile(r"\s*\[\]\s*(?=\{)").match(tex, end)):
        end = option.end()
    return rf"\{name}{{{'aligned' if kind in ALIGNED else kind}}}", end


def rewritten(tex: str, rules: dict[str, Rule] = RULES) -> str:
    """A formula with every command of the rules replaced, in one pass; depth doesn't matter."""
    stack, at = [_Open()], 0
    while at < len(tex):
        top = stack[-1]
        if top.name is not None:  # a command waits; a brace was seen to follow
            stack.append(_Open())
            at += 1
            continue
        c = tex[at]
        if c == "\\":
            m = _COMMAND.match(tex, at)
            name, rule, end = m[1], rules.get(m[1]), m.end()
            if name in ("begin", "end") and (found := _environment(tex, end, name)):
                top.parts.append(found[0])
                at = found[1]
            elif rule is None:
                top.parts.append(m[0])
                at = end
            else:
                begin = end
                while rule.options and (option := _OPTION.match(tex, begin)):
                    begin = option.end()
                brace = _SPACE.match(tex, begin).end()
                if not rule.groups:
                    top.parts.append(_filled(rule, []))
                    at = begin
                elif tex[brace : brace + 1] == "{":
                    stack.append(_Open(name, rule, tex[at:brace]))
                    at = brace
                elif rule.token and (token := _TOKEN.match(tex, end)):
                    top.parts.append(_filled(rule, [token[1]]))
                    at = token.end()
                else:
                    top.parts.append(m[0])
                    at = end
        elif c == "{":
            stack.append(_Open())
            at += 1
        elif c == "}" and len(stack) > 1:
            body, at = "".join(stack.pop().parts), at + 1
            owner = stack[-1]
            if owner.name is None:
                owner.parts.append(_font(body, 1) or f"{{{body}}}")
                continue
            owner.groups.append(body)
            owner.raw += f"{{{body}}}"
            rule, after = owner.rule, at
            while rule.options and len(owner.groups) < rule.groups and (option := _OPTION.match(tex, after)):
                after = option.end()
            after = _SPACE.match(tex, after).end()
            if rule.between and len(owner.groups) < rule.groups and tex.startswith(rule.between, after):
                after = _SPACE.match(tex, after + len(rule.between)).end()
            if len(owner.groups) == rule.groups:
                stack.pop()
                stack[-1].parts.append(_filled(rule, owner.groups))
                at = _SPACE.match(tex, at).end() if rule.eats else at
            elif tex[after : after + 1] == "{":
                owner.raw += tex[at:after]
                at = after
            else:
                stack.pop()
                stack[-1].parts.append(owner.raw)
        else:
            m = _PLAIN.match(tex, at)
            top.parts.append(m[0] if m else c)
            at = m.end() if m else at + 1
    while len(stack) > 1:  # what never closed is put back
        inner = stack.pop()
        text = "{" + "".join(inner.parts) if inner.name is None else inner.raw
        if stack[-1].name is None:
            stack[-1].parts.append(text)
        else:
            stack[-1].raw += text
    return "".join(stack[0].parts)


def normal_math(tex: str | None, rules: dict[str, Rule] = RULES) -> str | None:
    """A formula without comments at line ends and layout: rules first, then ends of lines without lengths, each once. Null stays null."""
    if tex is None:
        return None
    tex = rewritten(re.sub(r"%\r?\n", "", tex), rules)
    tex = re.sub(r"\\hline\s*\\\\", r"\\\\", tex)  # a rule that an end of line follows
    tex = re.sub(r"\\\\\s*\[[^\]]+\]", r"\\\\", tex)
    return re.sub(r"\\\\(?:\s*\\\\)+", r"\\\\", tex).strip()


def math(tex: Column, rules: dict[str, Rule] = RULES) -> Column:
    """normal_math() of a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normal_math(t, rules), na_action="ignore")

    return run(tex)


def rules_of(text: str) -> dict[str, Rule]:
    """The rules of a table in JSON: command_group_rules with commands, group_count and a strategy (template with replacement, unwrap, or keep_arg with keep_arg_index), which go before RULES."""
    out = dict(RULES)
    for entry in json.loads(text)["command_group_rules"]:
        n, how = int(entry["group_count"]), entry["strategy"]
        if how not in ("template", "unwrap", "keep_arg"):
            raise ValueError(f"unknown strategy: {how}")
        becomes = entry["replacement"] if how == "template" else "#1" if how == "unwrap" else f"#{int(entry['keep_arg_index']) + 1}"
        out |= {c: Rule(n, becomes, token=bool(entry.get("allow_single_token")), eats=True) for c in entry["commands"]}
    return out


def read_rules(spark: SparkSession, path: str) -> dict[str, Rule]:
    """rules_of() of a file in any store that Spark reads."""
    return rules_of(spark.read.text(path, wholetext=True).first()[0])
