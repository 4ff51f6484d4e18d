"""Service characters, release sequences and patterns, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ServiceChars:
    """The characters that a UNA header announces; the defaults hold where there is none."""

    component: str = ":"
    element: str = "+"
    decimal: str = "."
    release: str = "?"
    terminator: str = "'"

    def valid(self) -> bool:
        active = (self.component, self.element, self.release, self.terminator)
        return len(set(active)) == 4 and not any(c in " \t\r\n" for c in active)

    def una(self) -> str:
        """The nine characters of the header; every character must be ASCII and the active ones distinct."""
        every = self.component + self.element + self.decimal + self.release + self.terminator
        if len(every) != 5 or not every.isascii() or not self.valid():
            from tradewire.errors import EdiError, text

            raise EdiError("E007", text("E007"))
        return f"UNA{self.component}{self.element}{self.decimal}{self.release} {self.terminator}"


DEFAULT = ServiceChars()


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named: within a lambda nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def service_chars(content: Column, named: Column | None = None) -> Column:
    """Struct of the five characters that hold for the text; ``named``: whether it begins with a header."""
    named = content.startswith("UNA") & (F.octet_length(content) >= 9) if named is None else named
    pick = lambda at, default: F.when(named, F.substring(content, at, 1)).otherwise(F.lit(default))
    return F.struct(pick(4, ":").alias("component"), pick(5, "+").alias("element"), pick(6, ".").alias("decimal"), pick(7, "?").alias("release"), pick(9, "'").alias("terminator"), named.alias("named"))


def service_valid(ssa: Column) -> Column:
    """The four active characters differ, and each is one ASCII byte other than white space."""
    active = F.array(ssa["component"], ssa["element"], ssa["release"], ssa["terminator"])
    return (F.size(F.array_distinct(active)) == 4) & ~F.exists(active, lambda c: c.isin(" ", "\t", "\r", "\n") | (c > F.lit("\x7f")))


def quoted(c: Column | str) -> Column | str:
    return re.sub(r"([^\w\s])", r"\\\1", c) if isinstance(c, str) else F.regexp_replace(c, r"([^A-Za-z0-9\s])", r"\\$1")


def after_each(separator: Column | str, release: Column | str) -> Column:
    """Pattern whose group 1 is what follows each live ``separator``, up to the next one."""
    s, r = quoted(separator), quoted(release)
    if isinstance(s, str) and isinstance(r, str):
        return F.lit(f"(?s){s}((?:[^{s}{r}]++|{r}.)*+)")
    s, r = (F.lit(x) if isinstance(x, str) else x for x in (s, r))
    return F.concat(F.lit("(?s)"), s, F.lit("((?:[^"), s, r, F.lit("]++|"), r, F.lit(".)*+)"))


def up_to_each(terminator: Column | str, release: Column | str) -> Column:
    """Pattern whose group 1 is what comes before each live ``terminator``, from where the last one ended."""
    t, r = quoted(terminator), quoted(release)
    if isinstance(t, str) and isinstance(r, str):
        return F.lit(rf"(?s)\G((?:[^{t}{r}]++|{r}.)*+){t}")
    t, r = (F.lit(x) if isinstance(x, str) else x for x in (t, r))
    return F.concat(F.lit(r"(?s)\G((?:[^"), t, r, F.lit("]++|"), r, F.lit(".)*+)"), t)


def unescape(value: Column, release: Column | str = "?") -> Column:
    """Each release character and its follower become the follower alone."""
    r = quoted(release)
    pattern = F.lit(f"(?s){r}(.)") if isinstance(r, str) else F.concat(F.lit("(?s)"), r, F.lit("(.)"))
    held = value.contains(release) if isinstance(release, Column) else value.contains(F.lit(release))
    return F.when(held, F.regexp_replace(value, pattern, F.lit("$1"))).otherwise(value)


def escape(value: Column, chars: ServiceChars = DEFAULT) -> Column:
    """Put the release character before each of the four active characters."""
    live = "".join(quoted(c) for c in (chars.release, chars.element, chars.component, chars.terminator))
    put = chars.release.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(value, f"([{live}])", f"{put}$1")


def glob(value: Column, pattern: str) -> Column:
    """Whether the whole value matches; ``*`` stands for any run, all else for itself."""
    if "*" not in pattern:
        return value == F.lit(pattern)
    return value.rlike("(?s)^" + ".*".join("".join(quoted(c) for c in part) for part in pattern.split("*")) + r"\z")


def decimal_text(value: Column) -> Column:
    """Numbers of any size in the fewest digits, without an exponent and without a fraction of zero, as emitters write them."""

    def plain(s: Column) -> Column:
        special = F.when(s == "Infinity", "inf").when(s == "-Infinity", "-inf")
        long_ = F.when(s.contains("E"), held(F.split(s, "E"), lambda p: held(_digits(s, p), spread)))
        return F.coalesce(long_, special, F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s))

    def spread(d: Column) -> Column:
        digits, point = d["digits"], d["point"]
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        large = F.concat(digits, F.repeat(F.lit("0"), point - n))
        inner = F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
        return F.concat(d["sign"], F.when(point <= 0, small).when(point >= n, large).otherwise(inner))

    return held(value.cast("string"), plain)


def _digits(s: Column, parts: Column) -> Column:
    """Sign, digits and place of the point of a number with an exponent."""
    digits = F.rtrim(F.translate(F.get(parts, F.lit(0)), "-.", ""), F.lit("0"))
    point = F.get(parts, F.lit(1)).try_cast("int") + 1  # Java writes one digit before the point
    return F.struct(F.when(s.startswith("-"), "-").otherwise("").alias("sign"), digits.alias("digits"), point.alias("point"))
