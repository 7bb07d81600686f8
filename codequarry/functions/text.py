"""Column functions over identifiers, queries and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question is asked with.
STOP_WORDS = (
    "the an is are was how what where why when which who does do did in of to and or for with this that these it its be on by from as at we you can could should "
    "would into use used using work works file files code function functions method class there here about explain find show me my our all any get set if not no yes "
    "please happen happens"
).split()
#: Names too common to follow.
GENERIC_NAMES = (
    "add all any apply bind build call clear clone close copy count create data debug default delete drop emit equals error exec execute fetch filter find first flush format from get "
    "handle hash index info init insert into item items iter join key keys last len length list load log main map merge name new next open parse pop print process push put read reduce "
    "remove render replace reset resolve run save send set setup size sort split start stop test then to_string tostring trim update value values warn write __init__ constructor"
).split()
MAX_TERMS = 28
_BOUNDARIES = ("(?<=[a-z])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", "(?<=[0-9])(?=[A-Z])", "(?<=[A-Za-z0-9][A-Za-z])(?=[0-9])")


def identifiers(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w.rlike("^[A-Za-z_]"))


def split_identifier(name: Column) -> Column:
    """Lower-case pieces of two characters and more: at changes of case, before acronyms' last capital, and at digits."""
    for b in _BOUNDARIES:
        name = F.regexp_replace(name, b, " ")
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda p: F.length(p) >= 2)


def _with_pieces(w: Column, pieces_of_one: bool) -> Column:
    pieces = split_identifier(w)
    whole = F.filter(F.array(F.lower(w)), lambda x: F.length(x) >= 2)
    return F.concat(F.when(F.size(pieces) > 1, whole).otherwise(F.lit(None)), pieces) if pieces_of_one else F.concat(whole, F.when(F.size(pieces) > 1, pieces).otherwise(F.array().cast("array<string>")))


def terms_of(text: Column) -> Column:
    """The distinct identifiers of a text, lower-cased, each followed by its pieces where it has several."""
    return F.array_distinct(F.flatten(F.transform(identifiers(text), lambda w: _with_pieces(w, False))))


def query_terms(question: Column) -> Column:
    """What to search for: (text, prefix) of the question's identifiers and pieces without stop words, at most MAX_TERMS."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))

    def terms(w: Column) -> Column:
        pieces = split_identifier(w)
        whole = F.when(F.size(pieces) > 1, F.array(F.struct(F.lower(w).alias("text"), F.lit(False).alias("prefix")))).otherwise(F.expr("cast(array() as array<struct<text:string,prefix:boolean>>)"))
        return F.concat(whole, F.transform(pieces, lambda p: F.struct(p.alias("text"), (F.length(p) >= 4).alias("prefix"))))

    told = F.filter(F.flatten(F.transform(identifiers(question), terms)), lambda t: ~F.array_contains(stop, t["text"]))

    def once(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda a: a["text"] == t["text"]), acc).otherwise(F.array_append(acc, t))

    return F.slice(F.aggregate(told, F.expr("cast(array() as array<struct<text:string,prefix:boolean>>)"), once), 1, MAX_TERMS)


def match_expression(terms: Column) -> Column:
    """Terms as a full-text query: quoted, a star behind prefixes, joined by OR."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t["text"], F.lit('"'), F.when(t["prefix"], "*").otherwise(""))), " OR ")


def estimate_tokens(text: Column) -> Column:
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.floor(ascii_chars / 4) + F.floor((F.length(text) - ascii_chars) * 2 / 3) + 1).cast("long")


def is_generic_name(name: Column) -> Column:
    return (F.length(name) < 3) | F.lower(name).isin(*GENERIC_NAMES)


def is_task_prompt(text: Column) -> Column:
    """Whether a message sets a task: long enough, no command or tag, and at least two words to search for."""
    t = F.trim(text)
    return (F.length(t) >= 12) & ~t.rlike(r"^[/<\[!]") & ~F.lower(t).rlike(r"^(?:continue|go on|keep going)\b") & (F.size(query_terms(t)) >= 2)


#: Commands whose arguments are not run, and those that may stand beside version control.
NOT_A_RUN = (
    "git gh grep rg egrep findstr echo printf cat type ls dir find sed awk head tail wc which where diff select-string get-content write-host write-output curl wget rm cp mv mkdir touch"
).split()
BESIDE_VCS = "cd pushd popd set-location sl echo head tail cat grep".split()
#: Tools that run tests, by what must follow them: None if the tool alone does, else words, of which one stands anywhere behind it.
TESTED_BY = {
    "pytest py.test unittest nose2 tox nox vitest jest mocha ava rspec phpunit ctest behave": None,
    "npm pnpm yarn bun": ("test", "t", "check", "verify"),
    "cargo": ("test", "nextest"),
    "go dotnet swift deno flutter dart mix rails zig sbt playwright bazel": ("test",),
    "cypress": ("run",),
    "node": ("--test",),
    "manage.py": ("test", "check"),
    "mvn mvnw gradle gradlew": ("check", "verify", "build", "install", "package"),
}
#: Tools whose targets and scripts have names of their own, by what such a name holds if it tests.
TESTED_BY_NAME = {"npm pnpm yarn bun": ("test", "check", "verify"), "mvn mvnw gradle gradlew make just rake": ("test",)}
#: Words behind which a tool's other words name packages.
TAKES_PACKAGES = ("add", "install", "i", "ci", "remove", "uninstall", "update")


def _commands(line: Column) -> Column:
    """The commands of a shell line, each as its lower-case words without quotes, folders and program endings."""
    word = lambda w: F.regexp_replace(F.regexp_replace(F.translate(w, "\"'`()", ""), r"^(?!-).*[/\\](?=.)", ""), r"\.(?:exe|cmd|bat)$", "")
    words = lambda part: F.filter(F.transform(F.split(F.lower(part), r"\s+"), word), lambda w: w != "")
    return F.filter(F.transform(F.split(line, r"[\n;|&]"), words), lambda ws: F.size(ws) > 0)


def _one_of(names: tuple):
    return lambda word: F.element_at(F.split(word, ":"), -1).isin(*names)


def _holds(parts: tuple):
    return lambda word: word.rlike("|".join(parts))


def _tests(words: Column) -> Column:
    """Whether a command's words run tests."""
    plain = F.filter(words, lambda w: ~w.startswith("-"))  # flags are no targets

    def behind(tools: str, among: Column) -> Column:
        """The words behind the first of the tools; none without one."""
        at = F.array_max(F.transform(F.array(*map(F.lit, tools.split())), lambda t: F.coalesce(F.nullif(F.array_position(among, t), F.lit(0).cast("long")), F.lit(0).cast("long"))))
        return F.when(at > 0, F.slice(among, (at + 1).cast("int"), F.size(among))).otherwise(F.array().cast("array<string>"))

    found = F.lit(False)
    for tools, then in TESTED_BY.items():
        if then is None:
            found = found | F.arrays_overlap(words, F.array(*map(F.lit, tools.split())))
            continue
        rest = behind(tools, words)
        if tools == "cargo":  # its first word that is no toolchain
            rest = F.slice(F.filter(behind(tools, plain), lambda w: ~w.startswith("+")), 1, 1)
        hit = F.exists(rest, _one_of(then))
        found = found | (hit & ~F.coalesce(F.try_element_at(rest, F.lit(1)).isin(*TAKES_PACKAGES), F.lit(False)) if "npm" in tools else hit)
    for tools, parts in TESTED_BY_NAME.items():
        rest = behind(tools, plain)
        named = F.exists(rest, _holds(parts))
        found = found | (named & F.coalesce(F.arrays_overlap(rest, F.array(F.lit("run"), F.lit("run-script"))), F.lit(False)) if "npm" in tools else named)
    script = F.exists(words, lambda w: w.rlike(r"^run[-_]tests?(?:\.|$)|^tests?\.(?:sh|ps1|py|js)$"))
    by_python = F.try_element_at(words, F.lit(1)).rlike("^python") & F.exists(words, lambda w: w.rlike(r"^test_\w*\.py$|_test\.py$"))
    return found | script | F.coalesce(by_python, F.lit(False))


def is_test_command(command: Column) -> Column:
    """Whether a shell line runs tests; commands that only show or search their arguments don't."""
    return F.exists(_commands(command), lambda ws: ~F.element_at(ws, 1).isin(*NOT_A_RUN) & _tests(ws))


def is_vcs_only(command: Column) -> Column:
    """Whether a shell line calls version control, and beside it at most what moves about or shows."""
    firsts = F.transform(_commands(F.replace(command, F.lit("2>&1"), F.lit(""))), lambda ws: F.element_at(ws, 1))
    return F.forall(firsts, lambda w: w.isin("git", "gh", *BESIDE_VCS)) & F.exists(firsts, lambda w: w.isin("git", "gh"))


def risk(callers: Column, callers2: Column, modules: Column, cochanged: Column, untested: Column, framework: Column) -> Column:
    """(level, reason) of a change, by the first rule that holds."""
    rules = [
        (callers >= 10, "high", "callers"), (modules >= 2, "high", "modules"), (callers + callers2 >= 25, "high", "reach"), (callers >= 3, "medium", "callers"),
        (cochanged >= 3, "medium", "cochanged"), ((callers > 0) & untested, "medium", "untested"), (framework, "medium", "framework"),
    ]
    told = lambda level, reason: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))
    out = told("low", "")
    for rule, level, reason in reversed(rules):
        out = F.when(rule, told(level, reason)).otherwise(out)
    return out


def dice(a: Column, b: Column) -> Column:
    """Similarity of two strings as multisets of neighbouring characters."""

    def pairs(x: Column) -> Column:
        return F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    def count(xs: Column, y: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == y))

    pa, pb = pairs(a), pairs(b)
    both = F.aggregate(F.array_distinct(pa), F.lit(0), lambda acc, g: acc + F.least(count(pa, g), count(pb, g)))
    return F.when(F.size(pa) + F.size(pb) == 0, (a == b).cast("double")).otherwise(2.0 * both / (F.size(pa) + F.size(pb)))


def clean_subject(subject: Column) -> Column:
    """A commit's subject without its type, issue numbers and trailing marks."""
    s = F.regexp_replace(subject, r"^\w+(?:\([^)]*\))?!?:\s*", "")
    s = F.regexp_replace(s, r"\s*\(#\d+\)", "")
    s = F.regexp_replace(s, r"#\d+", "")
    return F.trim(F.regexp_replace(s, r"[\s.]+$", ""))


def html_text(html: Column) -> Column:
    """The text of a web page: scripts, styles and comments dropped, tags as spaces, common entities read, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def compact_number(n: Column) -> Column:
    """A number in thousands or millions with one decimal, as people write it."""
    told = F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000))
    return told.otherwise(n.cast("bigint").cast("string"))


def redact_url(text: Column) -> Column:
    """URLs without the names and passwords before their host."""
    return F.regexp_replace(text, r"(?i)\b([a-z][a-z0-9+.-]*://)[^/\s@]+@", "$1")


#: Patterns of secrets, of our own choice: keys by their beginnings, and values behind telling names.
SECRETS = (r"\b(?:sk|pk|ghp|gho|xox[bap])[-_][A-Za-z0-9_-]{16,}", r"\bAKIA[0-9A-Z]{16}\b", r"(?i)\b(?:api[_-]?key|secret|password|token)\b\s*[:=]\s*['\"]?[^\s'\"]{6,}")


def redact_secrets(text: Column) -> Column:
    """(text, count): secrets replaced, and how many there were."""
    pattern = "|".join(f"(?:{p})" for p in SECRETS)
    return F.struct(F.regexp_replace(text, pattern, "[redacted]").alias("text"), F.regexp_count(text, F.lit(pattern)).alias("count"))


def failure_print(output: Column, lines: int = 15) -> Column:
    """The last lines of an output that aren't blank, without digits: equal failures have equal ones."""
    kept = F.filter(F.split(output, "\n"), lambda x: F.trim(x) != "")
    last = F.slice(kept, F.greatest(F.size(kept) - lines + 1, F.lit(1)), lines)
    return F.regexp_replace(F.array_join(last, "\n"), "[0-9]", "")


def working_dir(command: Column) -> Column:
    """The folder that a command changes to first; null for others."""
    return F.nullif(F.regexp_extract(command, r"""^\s*cd\s+["']?([^"'&;|]+?)["']?\s*(?:&&|;)""", 1), F.lit(""))


def in_development(commit: Column) -> Column:
    """The fixed split of questions by their commit: three tenths are for development."""
    return F.conv(F.substring(commit, 1, 8), 16, 10).cast("long") % 10 < 3


def changed_span(before: Column, after: Column) -> Column:
    """(start, end_before, end_after): what is left of two lines without their common beginning and end."""
    n = F.least(F.length(before), F.length(after))
    upto = F.sequence(F.lit(1), n)
    head = F.when(n > 0, F.coalesce(F.array_max(F.filter(upto, lambda k: F.substring(before, F.lit(1), k) == F.substring(after, F.lit(1), k))), F.lit(0))).otherwise(0)
    tail = F.when(n - head > 0, F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), n - head), lambda k: F.right(before, k) == F.right(after, k))), F.lit(0))).otherwise(0)
    return F.struct(head.alias("start"), (F.length(before) - tail).alias("end_before"), (F.length(after) - tail).alias("end_after"))


def baseline_tokens(text: Column) -> Column:
    """The plain estimate of four characters a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def plural(n: Column, word: Column) -> Column:
    """A number with its word in the singular or plural."""
    ending = F.when(n == 1, "").when(word.endswith("s"), "es").otherwise("s")
    return F.concat(n.cast("string"), F.lit(" "), word, ending)


def host_allowed(url: Column, domains: tuple[str, ...]) -> Column:
    """Whether a URL's host is one of the domains or below one; `*.` before a domain and blanks around it don't count."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    found = F.lit(False)
    for d in (d.strip().removeprefix("*.").lower() for d in domains):
        if d:
            found = found | (host == d) | host.endswith("." + d)
    return found


def carries_data(url: Column) -> Column:
    """Whether a URL may carry data away: long queries or fragments, or a long value or path segment in it."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    value = F.exists(F.split(query, "&"), lambda v: F.length(F.regexp_replace(v, "^[^=]*=?", "")) > 40)
    segment = F.exists(F.split(path, "/"), lambda s: F.length(s) > 80)
    return (F.octet_length(query) > 120) | (F.octet_length(F.regexp_extract(url, "#(.*)$", 1)) > 80) | value | segment


def command_allowed(command: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a command is an allowed one, alone or with arguments, and joins or redirects nothing."""
    found = F.lit(False)
    for a in allowed:
        found = found | (command == a) | command.startswith(a + " ")
    return found & ~command.rlike(r"[&|;><`$\n]")


def diff_line(line: Column) -> Column:
    """What a line of a unified diff is: old or new (the files' names), hunk, deleted, added, or context; other lines are null."""
    kinds = [("--- ", "old"), ("+++ ", "new"), ("@@ -", "hunk"), ("-", "deleted"), ("+", "added"), (" ", "context")]
    return F.coalesce(*(F.when(line.startswith(start), kind) for start, kind in kinds))


def leaked(rewrite: Column, source: Column, gold: Column) -> Column:
    """The distinct identifiers of gold that a rewritten question holds but its source doesn't; a null text holds none."""
    one, two, three = (identifiers(F.coalesce(x, F.lit(""))) for x in (rewrite, source, gold))
    return F.array_sort(F.array_intersect(F.array_except(one, two), three))
