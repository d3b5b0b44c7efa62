"""Names of the Itanium C++ ABI, parsed from its published grammar; anything else passes through unchanged."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ABI's codes.
BUILTINS = {
    "v": "void", "w": "wchar_t", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char", "s": "short", "t": "unsigned short", "i": "int", "j": "unsigned int", "l": "long", "m": "unsigned long",
    "x": "long long", "y": "unsigned long long", "n": "__int128", "o": "unsigned __int128", "f": "float", "d": "double", "e": "long double", "g": "__float128", "z": "...",
}
BUILTINS_D = {"d": "decimal64", "e": "decimal128", "f": "decimal32", "h": "half", "i": "char32_t", "s": "char16_t", "u": "char8_t", "a": "auto", "c": "decltype(auto)", "n": "decltype(nullptr)"}
OPERATOR_CODES = {
    "nw": "new", "na": "new[]", "dl": "delete", "da": "delete[]", "ps": "+", "ng": "-", "ad": "&", "de": "*", "co": "~", "pl": "+", "mi": "-", "ml": "*", "dv": "/", "rm": "%", "an": "&", "or": "|", "eo": "^", "aS": "=",
    "pL": "+=", "mI": "-=", "mL": "*=", "dV": "/=", "rM": "%=", "aN": "&=", "oR": "|=", "eO": "^=", "ls": "<<", "rs": ">>", "lS": "<<=", "rS": ">>=", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "ss": "<=>",
    "nt": "!", "aa": "&&", "oo": "||", "pp": "++", "mm": "--", "cm": ",", "pm": "->*", "pt": "->", "cl": "()", "ix": "[]", "qu": "?",
}
ABBREVIATIONS = {"St": "std", "Sa": "std::allocator", "Sb": "std::basic_string", "Ss": "std::string", "Si": "std::istream", "So": "std::ostream", "Sd": "std::iostream"}
SPECIAL = {"TV": "vtable for ", "TT": "VTT for ", "TI": "typeinfo for ", "TS": "typeinfo name for ", "GV": "guard variable for ", "GR": "reference temporary for ", "TW": "TLS wrapper function for ", "TH": "TLS init function for "}
DEEPEST = 2048


class _Bad(Exception):
    """The name doesn't follow the grammar."""


class _Parser:
    def __init__(self, text: str):
        self.s, self.i, self.subs, self.args, self.deep = text, 0, [], [], 0

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def take(self, prefix: str) -> bool:
        if self.s.startswith(prefix, self.i):
            self.i += len(prefix)
            return True
        return False

    def need(self, prefix: str) -> None:
        if not self.take(prefix):
            raise _Bad

    def enter(self) -> None:
        self.deep += 1
        if self.deep > DEEPEST:
            raise _Bad

    def number(self) -> int:
        m = re.compile(r"n?\d+").match(self.s, self.i)
        if not m:
            raise _Bad
        self.i = m.end()
        return -int(m[0][1:]) if m[0][0] == "n" else int(m[0])

    def sequence(self, table: list[str]) -> str:
        """The entry that a base-36 number and an underscore name."""
        m = re.compile(r"([0-9A-Z]*)_").match(self.s, self.i)
        if not m:
            raise _Bad
        self.i = m.end()
        n = int(m[1], 36) + 1 if m[1] else 0
        if n >= len(table):
            raise _Bad
        return table[n]

    def source_name(self) -> str:
        n = self.number()
        name = self.peek(n)
        if n <= 0 or len(name) < n:
            raise _Bad
        self.i += n
        return "(anonymous namespace)" if name.startswith("_GLOBAL__N") else name

    def encoding(self, params: bool) -> str:
        for code, words in SPECIAL.items():
            if self.take(code):
                return words + (self.type() if code in ("TV", "TT", "TI", "TS") else self.name()[0])
        if self.peek() == "T" and self.peek(2) in ("Th", "Tv"):
            words = "non-virtual thunk to " if self.peek(2) == "Th" else "virtual thunk to "
            self.i += 2
            for _ in range(1 if words[0] == "n" else 2):
                self.number()
                self.need("_")
            return words + self.encoding(params)
        name, templated, suffix = self.name()
        if self.i >= len(self.s) or self.peek() in "E.":
            return name + suffix
        result = ""
        if templated and not self.no_result(name):
            result = self.type() + " "
        args = []
        while self.i < len(self.s) and self.peek() not in "E.":
            args.append(self.type())
        if args == ["void"]:
            args = []
        return f"{result}{name}({', '.join(args)}){suffix}" if params else name

    @staticmethod
    def no_result(name: str) -> bool:
        """Constructors, destructors and conversions have no result type."""
        bare = re.sub(r"<.*>", "", name)
        parts = bare.split("::")
        return len(parts) > 1 and (parts[-1] == parts[-2] or parts[-1].startswith("~")) or "operator " in parts[-1] and parts[-1].split("operator ")[-1][:1].isalpha() and not parts[-1].startswith(("operator new", "operator delete"))

    def name(self) -> tuple[str, bool, str]:
        """The name, whether template arguments end it, and qualifiers of the function."""
        self.enter()
        try:
            if self.peek() == "N":
                return self.nested()
            if self.peek() == "Z":
                return self.local()
            if self.peek() == "S" and self.peek(2) != "St":
                name = self.substitution()
                known = True
            else:
                if self.take("St"):
                    name = "std::" + self.unqualified("")
                else:
                    name = self.unqualified("")
                known = False
            if self.peek() == "I":
                if not known:
                    self.subs.append(name)
                return name + " " * name.endswith("<") + self.template_args(), True, ""
            return name, False, ""
        finally:
            self.deep -= 1

    def nested(self) -> tuple[str, bool, str]:
        self.need("N")
        quals = ""
        while self.peek() and self.peek() in "rVK":
            quals = {"r": " restrict", "V": " volatile", "K": " const"}[self.peek()] + quals
            self.i += 1
        quals += " &" if self.take("R") else " &&" if self.take("O") else ""
        name, templated = "", False
        while not self.take("E"):
            if self.i >= len(self.s):
                raise _Bad
            c = self.peek()
            if c == "I" and name:
                name += " " * name.endswith("<") + self.template_args()
                templated = True
            elif c == "S" and self.peek(2) == "St" and not name:
                self.i += 2
                name = "std"
                continue
            elif c == "S" and not name:
                name, templated = self.substitution(), False
                continue
            elif c == "T" and not name:
                name = self.template_param()
            elif c == "L":
                self.i += 1
                continue
            else:
                part = self.unqualified(name)
                name = f"{name}::{part}" if name else part
                templated = False
            if self.peek() != "E":
                self.subs.append(name)
        return name, templated, quals

    def local(self) -> tuple[str, bool, str]:
        self.need("Z")
        outer = self.encoding(True)
        self.need("E")
        if self.take("s"):
            inner, templated, quals = "string literal", False, ""
        else:
            if self.take("d"):
                if self.peek() != "_":
                    self.number()
                self.need("_")
            inner, templated, quals = self.name()
        if self.take("__"):
            self.number()
            self.need("_")
        elif self.peek() == "_":
            self.i += 2
        return f"{outer}::{inner}", templated, quals

    def unqualified(self, scope: str) -> str:
        c = self.peek()
        if c.isdigit():
            name = self.source_name()
        elif c == "C" and self.peek(2)[1:] in tuple("12345"):
            self.i += 2
            name = re.sub(r"<.*>$", "", scope).split("::")[-1]
            if scope == "std::string":
                name = "basic_string"
        elif c == "D" and self.peek(2)[1:] in tuple("01245"):
            self.i += 2
            name = "~" + re.sub(r"<.*>$", "", scope).split("::")[-1]
        elif self.take("Ut"):
            n = 1 if self.peek() == "_" else self.number() + 2
            self.need("_")
            name = f"{{unnamed type#{n}}}"
        elif self.take("Ul"):
            args = []
            while not self.take("E"):
                args.append(self.type())
            n = 1 if self.peek() == "_" else self.number() + 2
            self.need("_")
            name = f"{{lambda({', '.join([] if args == ['void'] else args)})#{n}}}"
        elif self.take("cv"):
            name = "operator " + self.type()
        elif self.take("li"):
            name = 'operator"" ' + self.source_name()
        elif self.peek(2) in OPERATOR_CODES:
            op = OPERATOR_CODES[self.peek(2)]
            self.i += 2
            name = "operator" + (" " if op[0].isalpha() else "") + op
        elif c == "L":
            self.i += 1
            return self.unqualified(scope)
        else:
            raise _Bad
        while self.take("B"):
            name += f"[abi:{self.source_name()}]"
        return name

    def substitution(self) -> str:
        self.need("S")
        two = "S" + self.peek()
        if two in ABBREVIATIONS:
            self.i += 1
            if two == "St":
                name = "std::" + self.unqualified("")
                self.subs.append(name)
                return name
            return ABBREVIATIONS[two]
        return self.sequence(self.subs)

    def template_param(self) -> str:
        self.need("T")
        return self.sequence(self.args)

    def template_args(self) -> str:
        self.need("I")
        self.enter()
        own: list[str] = []
        while not self.take("E"):
            own.append(self.template_arg())
        self.deep -= 1
        self.args = own
        text = ", ".join(x for x in own if x)
        return f"<{text}{' ' if text.endswith('>') else ''}>"

    def template_arg(self) -> str:
        if self.take("L"):
            if self.take("_Z"):
                name = self.encoding(True)
                self.need("E")
                return f"&{name}" if "(" not in name else name
            kind = self.type()
            m = re.compile(r"n?[0-9a-f.]*").match(self.s, self.i)
            value = m[0].replace("n", "-", 1)
            self.i = m.end()
            self.need("E")
            if kind == "bool":
                return "true" if value == "1" else "false"
            suffix = {"int": "", "unsigned int": "u", "long": "l", "unsigned long": "ul", "long long": "ll", "unsigned long long": "ull"}
            return value + suffix[kind] if kind in suffix else f"({kind}){value}"
        if self.take("J"):
            own = []
            while not self.take("E"):
                own.append(self.template_arg())
            return ", ".join(own)
        if self.take("X"):
            text = self.expression()[0]
            self.need("E")
            return text
        return self.type()

    def expression(self) -> tuple[str, bool]:
        """An expression and whether it is a name, which stands without brackets inside others."""
        self.enter()
        try:
            return self._expression()
        finally:
            self.deep -= 1

    def _operand(self) -> str:
        text, plain = self.expression()
        return text if plain else f"({text})"

    def _list(self) -> str:
        own = []
        while not self.take("E"):
            own.append(self.expression()[0])
        return ", ".join(own)

    def _expression(self) -> tuple[str, bool]:
        code = self.peek(2)
        if self.take("L_Z"):
            name = self.encoding(False)
            self.need("E")
            return name, True
        if code[:1] == "L":
            return self.template_arg(), False
        if code[:1] == "T":
            return self.template_param(), False
        if code[:1].isdigit():
            name = self.source_name()
            return name + (self.template_args() if self.peek() == "I" else ""), True
        self.i += 2
        if code == "fp":
            n = 1 if self.peek() == "_" else self.number() + 2
            self.need("_")
            return f"{{parm#{n}}}", True
        if code == "sr":
            # Plain names of levels are no substitutions.
            name = self.source_name() + (self.template_args() if self.peek() == "I" else "") if self.peek().isdigit() else self.type()
            while True:  # levels, then an E before the last one where the type is unresolved
                last = self.peek() == "E" and self.peek(2)[1:].isdigit()
                self.i += last
                name += f"::{self.unqualified('')}" + (self.template_args() if self.peek() == "I" else "")
                if last or not (self.peek().isdigit() or self.peek() == "E" and self.peek(2)[1:].isdigit()):
                    return name, True
        if code in ("st", "at"):
            return f"{'sizeof' if code == 'st' else 'alignof'} ({self.type()})", False
        if code in ("sz", "az"):
            return f"{'sizeof' if code == 'sz' else 'alignof'} {self._operand()}", False
        if code == "cv":
            kind = self.type()
            return (f"{kind}({self._list()})" if self.take("_") else f"({kind}){self._operand()}"), False
        if code == "cl":
            called = self._operand()
            return f"{called}({self._list()})", False
        if code in ("dt", "pt"):
            return f"{self._operand()}{'.' if code == 'dt' else '->'}{self.unqualified('')}", False
        if code == "sp":
            return self.expression()
        if code == "qu":
            return f"{self._operand()}?{self._operand()} : {self._operand()}", False
        if code not in OPERATOR_CODES or code in ("nw", "na", "dl", "da", "pp", "mm", "ix"):
            raise _Bad
        if code in ("ps", "ng", "ad", "de", "co", "nt"):
            return OPERATOR_CODES[code] + self._operand(), False
        text = f"{self._operand()}{OPERATOR_CODES[code]}{self._operand()}"
        return (f"({text})" if code == "gt" else text), False

    def type(self) -> str:
        self.enter()
        try:
            return self._type()
        finally:
            self.deep -= 1

    def _type(self) -> str:
        c = self.peek()
        if not c:
            raise _Bad
        if c in "rVK":
            quals = ""
            while self.peek() and self.peek() in "rVK":
                quals = {"r": " restrict", "V": " volatile", "K": " const"}[self.peek()] + quals
                self.i += 1
            inner = self.type()
            name = self._qualify(inner, quals)
        elif c in "PRO":
            self.i += 1
            inner, mark = self.type(), {"P": "*", "R": "&", "O": "&&"}[c]
            name = self._point(inner, mark)
        elif c == "F":
            name = self.function_type()
        elif c == "A":
            self.i += 1
            size = "" if self.peek() == "_" else str(self.number())
            self.need("_")
            name = f"{self.type()} [{size}]"
        elif c == "M":
            self.i += 1
            of, member = self.type(), self.type()
            name = self._point(member, f"{of}::*") if "(" in member else f"{member} {of}::*"
        elif c == "T":
            name = self.template_param()
            if self.peek() == "I":
                self.subs.append(name)
                name += self.template_args()
        elif c == "S" and self.peek(2) != "St":
            name = self.substitution()
            if self.peek() == "I":
                name += self.template_args()
            else:
                return name
        elif c == "D" and self.peek(2) in ("DT", "Dt"):
            self.i += 2
            name = f"decltype ({self.expression()[0]})"
            self.need("E")
        elif c == "D" and self.peek(2) == "Dp":
            self.i += 2
            name = self.type()
        elif c == "D" and self.peek(2)[1:] in BUILTINS_D:
            self.i += 2
            return BUILTINS_D[self.s[self.i - 1]]
        elif c in BUILTINS:
            self.i += 1
            return BUILTINS[c]
        elif c == "u":
            self.i += 1
            return self.source_name()
        else:
            name = self.name()[0]
        self.subs.append(name)
        return name

    @staticmethod
    def _qualify(inner: str, quals: str) -> str:
        return f"{inner}{quals}"

    @staticmethod
    def _point(inner: str, mark: str) -> str:
        if inner.endswith("]"):
            head, _, tail = inner.partition(" [")
            return f"{head} ({mark}) [{tail}"
        m = re.match(r"(.*?) \(\)(\(.*)$", inner) if " ()(" in inner else None
        if m:
            return f"{m[1]} ({mark}){m[2]}"
        if mark in ("&", "&&") and inner.endswith("&"):
            return inner.rstrip("&") + "&" if mark == "&" or inner.endswith("&") and not inner.endswith("&&") else inner
        at = inner.find("(*")
        if at >= 0 and inner.endswith(")") and " (*" in inner:
            return inner.replace("(*", f"(*{mark}" if mark == "*" else f"(*{mark}", 1)
        return inner + mark

    def function_type(self) -> str:
        self.need("F")
        self.take("Y")
        result = self.type()
        args = []
        while not self.take("E"):
            args.append(self.type())
        if args == ["void"]:
            args = []
        return f"{result} ()({', '.join(args)})"


def demangle_name(symbol: str | None, params: bool = True) -> str | None:
    """The C++ name of a mangled symbol, with or without parameter types; other symbols as they are."""
    if not symbol or not symbol.startswith(("_Z", "__Z", "_GLOBAL_")):
        return symbol
    if symbol.startswith("_GLOBAL_"):
        m = re.fullmatch(r"_GLOBAL_[._$]([ID])_(.+)", symbol)
        if not m:
            return symbol
        return f"global {'constructors' if m[1] == 'I' else 'destructors'} keyed to {demangle_name(m[2], params)}"
    plain = symbol.split(".")[0]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEEPEST))
    p = _Parser(plain[2:] if plain.startswith("_Z") else plain[3:])
    try:
        out = p.encoding(params)
    except (_Bad, IndexError, ValueError, RecursionError):
        return symbol
    return out if p.i == len(p.s) else symbol


def without_balanced_templates(symbol: str | None) -> str | None:
    """Template arguments out, innermost brackets matched; operators that hold brackets stay. Unbalanced names are kept whole."""
    if not symbol or "<" not in symbol:
        return symbol
    out, depth, i = "", 0, 0
    while i < len(symbol):
        c = symbol[i]
        m = re.compile(r"operator(<=>|<<=|>>=|->\*|<<|>>|<=|>=|->|<|>)").match(symbol, i) if depth == 0 else None
        if m and (i == 0 or not (symbol[i - 1].isalnum() or symbol[i - 1] == "_")):
            out += m[0]
            i = m.end()
            continue
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif depth == 0:
            out += c
        i += 1
    return out if depth == 0 else symbol


def demangled(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``full_name``, ``name`` (without parameters) and ``plain`` (without template arguments) of a column of
    symbols: each symbol is parsed once, however often it occurs."""
    names = rows.select(F.col(column).alias("_symbol")).distinct()
    names = names.select("_symbol", demangle("_symbol").alias("full_name"), demangle_short("_symbol").alias("name")).withColumn("plain", strip_templates("name"))
    return rows.join(names, rows[column].eqNullSafe(names["_symbol"])).drop("_symbol")


@F.pandas_udf(T.StringType())
def demangle(symbols: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in symbols:
        yield part.map(demangle_name)


@F.pandas_udf(T.StringType())
def demangle_short(symbols: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in symbols:
        yield part.map(lambda s: demangle_name(s, params=False))


@F.pandas_udf(T.StringType())
def strip_templates(symbols: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in symbols:
        yield part.map(without_balanced_templates)
