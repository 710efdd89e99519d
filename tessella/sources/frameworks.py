"""Edges that frameworks make: routes to handlers, markup to components, and calls across languages, as rules in a table.

A framework is looked for only in repositories where it is detected, by a manifest, by imports or by the files that there are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.sources import languages


class Sign(NamedTuple):
    """A repository that has a file of this path with this content uses the framework."""

    framework: str
    path: str
    content: str = ""


class Rule(NamedTuple):
    """In files of this path, what the pattern's groups name is called; confidence is null for what stands in the text.

    `to` puts the name together from the groups, the last one if it is empty. `inside`: the edge is from the function around."""

    framework: str
    path: str
    pattern: str
    confidence: float | None = None
    to: str = ""
    inside: bool = False


_ECMA, _PACKAGE = r"\.(?:[jt]sx?|mjs|cjs)$", r"(?:^|/)package\.json$"
_ROUTE = r"""['"][^'"\n]*['"]\s*,\s*(?:[\w.]+\s*,\s*)*"""
#: The signs of each framework.
SIGNS = (
    Sign("angular", _PACKAGE, r'"@angular/(?:core|common)"'),
    Sign("django", r"\.py$", r"(?m)^\s*(?:from|import)\s+django\b"), Sign("django", r"(?:^|/)(?:manage|settings)\.py$", "django"),
    Sign("expo", _PACKAGE, r'"expo"'),
    Sign("express", _PACKAGE, r'"express"'),
    Sign("fastapi", r"\.py$", r"(?m)^\s*(?:from|import)\s+fastapi\b"), Sign("fastapi", r"(?:^|/)(?:requirements\.txt|pyproject\.toml)$", "fastapi"),
    Sign("flutter", r"(?:^|/)pubspec\.yaml$", "flutter"),
    Sign("gin", r"(?:^|/)go\.mod$", "github.com/gin-gonic/gin"),
    Sign("laravel", r"(?:^|/)composer\.json$", "laravel/framework"), Sign("laravel", r"(?:^|/)artisan$"),
    Sign("nestjs", _PACKAGE, r'"@nestjs/(?:core|common)"'),
    Sign("nextjs", _PACKAGE, r'"next"'),
    Sign("rails", r"(?:^|/)Gemfile$", r"""['"]rails['"]"""), Sign("rails", r"(?:^|/)config/routes\.rb$"),
    Sign("react", _PACKAGE, r'"react(?:-dom)?"'),
    Sign("spring", r"\.(?:java|kt)$", r"(?m)^import\s+org\.springframework\b"), Sign("spring", r"(?:^|/)(?:pom\.xml|build\.gradle(?:\.kts)?)$", "org.springframework"),
    Sign("sveltekit", _PACKAGE, r'"@sveltejs/kit"'),
)
#: Frameworks that are there when a repository has files of each of these kinds.
TOGETHER = {"java-kotlin": (r"\.java$", r"\.kt$"), "swift-objc": (r"\.swift$", r"\.(?:mm?|h)$")}
RULES = (
    Rule("angular", r"\.ts$", r"@(?:Component|NgModule|Directive|Injectable|Pipe)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    Rule("django", r"(?:^|/)urls\.py$", r"""\b(?:re_)?path\(\s*r?['"][^'"\n]*['"]\s*,\s*(?:\w+\.)*?(\w+)(?:\.as_view\([^()]*\))?\s*[,)]"""),
    Rule("expo", _ECMA, r"""\bfrom\s+['"](@expo/[\w-]+|expo-[\w-]+)['"]""", 0.9),
    Rule("expo", _ECMA, r"""\bimport\s+(?:\{\s*)?(\w+)[^'"\n]*\bfrom\s+['"](?:@expo/[\w-]+|expo-[\w-]+)['"]""", 0.85),
    Rule("express", _ECMA, rf"\b(?:app|router)\.(?:get|post|put|patch|delete|all|options|head)\(\s*{_ROUTE}(?:\w+\.)*(\w+)\s*\)"),
    Rule("express", _ECMA, r"""\b(?:app|router)\.use\(\s*(?:['"][^'"\n]*['"]\s*,\s*)?(?:\w+\.)*([A-Za-z_]\w*)\s*(?:\(\s*\))?\s*\)"""),
    Rule("fastapi", r"\.py$", r"@\w+\.(?:get|post|put|patch|delete|options|head|websocket)\([^\n]*\)\s*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async\s+)?def\s+(\w+)"),
    Rule("flutter", r"\.dart$", r"\bMaterialPageRoute\((?:[^;{}])*?builder:\s*\([^)]*\)\s*=>\s*(?:const\s+)?([A-Z]\w*)", inside=True),
    Rule("flutter", r"\.dart$", r"""\bpushNamed\(\s*\w+\s*,\s*['"]([^'"\n]+)['"]""", inside=True),
    Rule("flutter", r"\.dart$", r"\bGoRoute\((?:[^;{}])*?builder:\s*\([^)]*\)\s*=>\s*(?:const\s+)?([A-Z]\w*)", inside=True),
    Rule("flutter", r"\.dart$", r"\bchild:\s*(?:const\s+)?([A-Z]\w*)\(", 0.85, inside=True),
    Rule("gin", r"\.go$", r"""\.(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any)\(\s*"[^"\n]*"\s*,\s*(?:[\w.]+\s*,\s*)*(?:\w+\.)*(\w+)\s*\)"""),
    Rule("gin", r"\.go$", r"\.Use\(\s*(?:\w+\.)*(\w+)(?:\(\s*\))?\s*\)"),
    Rule("java-kotlin", r"\.kt$", r"@Jvm(?:Static|Overloads)\b[^\n]*\s+(?:\w+\s+)*?fun\s+(\w+)", 0.8),
    Rule("java-kotlin", r"\.kt$", r"@JvmField\b[^\n]*?\b(?:val|var)\s+(\w+)", 0.75),
    Rule("java-kotlin", r"\.java$", r"(?m)^import\s+(?:static\s+)?[\w.]*?\b(\w+Kt)\b", 0.75),
    Rule("java-kotlin", r"\.java$", r"\b[A-Z]\w*\.Companion\.(\w+)", 0.7),
    Rule("laravel", r"\.php$", r"""\bRoute::\w+\(\s*['"][^'"\n]*['"]\s*,\s*\[\s*([\w\\]+)::class\s*,\s*['"](\w+)['"]"""),
    Rule("laravel", r"\.php$", r"""\bRoute::\w+\(\s*['"][^'"\n]*['"]\s*,\s*['"]([\w\\]+)@(\w+)['"]"""),
    Rule("nestjs", r"\.ts$", r"@(?:Get|Post|Put|Patch|Delete|All|Options|Head)\([^)\n]*\)\s*(?:@[^\n]*\n\s*)*(?:public\s+)?(?:async\s+)?(\w+)\s*\("),
    Rule("rails", r"(?:^|/)config/routes\.rb$", r"""['"](\w+)#(\w+)['"]""", to="{camel}Controller"),
    Rule("rails", r"(?:^|/)config/routes\.rb$", r"(?m)^\s*resources?\s+:(\w+)", to="{camel}Controller"),
    Rule("react", r"\.[jt]sx$", r"<([A-Z]\w*(?:\.\w+)*)(?=[\s/>])", inside=True),
    Rule("spring", r"\.(?:java|kt)$", r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping(?:\([^)\n]*\))?\s*(?:@[^\n]*\n\s*)*(?:(?:public|private|protected)\s+)?(?:fun\s+|[\w<>?\[\], ]+\s+)(\w+)\s*\("),
    Rule("sveltekit", r"(?:^|/)routes/.*\.(?:[jt]s|svelte)$", r"\bexport\s+(?:async\s+)?(?:function|const)\s+(load|actions)\b"),
    Rule("swift-objc", r"\.swift$", r"@objc(?:\([\w:]*\))?\s+(?:\w+\s+)*?(?:func|var|class)\s+(\w+)", 0.8),
    Rule("swift-objc", r"\.mm?$", r"\[\s*[A-Za-z_]\w*\s+([A-Za-z_]\w*)", 0.6),
    Rule("swift-objc", r"\.mm?$", r"""\#import\s+"([\w-]+)-Swift\.h\"""", 0.5),
)


def detected(files: DataFrame, signs: tuple[Sign, ...] = SIGNS) -> DataFrame:
    """(repo, framework) of files (repo, file, text): one pass, a row of flags for each repository."""
    names = sorted({s.framework for s in signs})
    flags = []
    for name in names:
        there = F.lit(False)
        for s in signs:
            if s.framework == name:
                there = there | (F.col("file").rlike(s.path) & (F.coalesce(F.col("text").rlike(s.content), F.lit(False)) if s.content else F.lit(True)))
        flags.append(F.bool_or(there & ~F.col("file").rlike(r"(?:^|/)node_modules/")).alias(name))
    for name, kinds in TOGETHER.items():
        flags += [F.bool_or(F.col("file").rlike(k)).alias(f"{name}_{n}") for n, k in enumerate(kinds)]
    found = files.groupBy("repo").agg(*flags)
    both = [F.when(F.col(f"{n}_0") & F.col(f"{n}_1"), F.lit(n)) for n in TOGETHER]
    every = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names], *both))
    return found.select("repo", F.explode(every).alias("framework"))


def next_route(file: Column) -> Column:
    """The route that a file of Next.js serves, null for others: its place under app (pages and route handlers) or pages."""
    clean, ends = paths.slashed(file), r"\.(?:[jt]sx?|mjs|cjs)$"
    app = F.when(clean.rlike(r"(?:^|/)app/(?:.*/)?(?:page|route)" + ends), F.regexp_extract(clean, r"(?:^|/)app/((?:.*/)?)(?:page|route)" + ends, 1))
    page = F.when(clean.rlike(r"(?:^|/)pages/.+" + ends), F.regexp_replace(F.regexp_extract(clean, r"(?:^|/)pages/(.+)" + ends, 1), r"(?:^|/)index$", ""))
    return F.when(~F.contains(clean, F.lit("node_modules/")), F.concat(F.lit("/"), F.trim(F.coalesce(app, page), F.lit("/"))))


def _camel(word: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in word.split("_"))


def edges_of(file: str, text: str, active: set[str], rules: tuple[Rule, ...] = RULES) -> list[tuple]:
    """(framework, from_fqn, to_name, line, confidence) of one file."""
    out, symbols = [], None
    for rule in rules:
        if rule.framework not in active or not re.search(rule.path, file):
            continue
        for m in re.finditer(rule.pattern, text):
            line, origin = text.count("\n", 0, m.start(m.lastindex)) + 1, file
            if rule.inside:
                if symbols is None:
                    language = paths.BY_EXTENSION.get(file.rsplit(".", 1)[-1], "other")
                    symbols = [s for s in languages.parsed(file, text, language).symbols if s.kind in ("function", "method")]
                around = [s for s in symbols if s.line_start <= line <= s.line_end]
                origin = min(around, key=lambda s: s.line_end - s.line_start).fqn if around else file
            to = rule.to.format(camel=_camel(m[1])) if rule.to else m[m.lastindex]
            out.append((rule.framework, origin, to, line, rule.confidence))
    return out


_ROWS = "file string, framework string, from_fqn string, to_name string, line int, confidence double"


def _found(rules: tuple[Rule, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(file, *e) for file, text, active in zip(frame["file"], frame["text"], frame["active"]) for e in edges_of(file, text, set(active), rules)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")])

    return run


def framework_edges(files: DataFrame, signs: tuple[Sign, ...] = SIGNS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(file, framework, from_fqn, to_name, line, confidence) of files (repo, file, text), by the rules of the frameworks of
    each repository; Next.js files call their routes. A user's own frameworks are further signs and rules."""
    active = detected(files, signs)
    by_repo = active.groupBy("repo").agg(F.collect_set("framework").alias("active"))  # as many entries as there are frameworks
    used = files.where("text is not null").join(by_repo, "repo")
    found = used.select("file", "text", "active").mapInPandas(_found(rules), _ROWS)
    route = next_route(F.col("file"))
    routes = used.where(F.array_contains("active", "nextjs") & route.isNotNull()).select("file", F.lit("nextjs").alias("framework"), F.col("file").alias("from_fqn"), route.alias("to_name"), F.lit(1).alias("line"), F.lit(None).cast("double").alias("confidence"))
    return found.unionByName(routes)
