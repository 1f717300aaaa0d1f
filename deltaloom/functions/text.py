"""Column functions on names, texts, error messages and log values; all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "\ufeff"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


# ---- names -----------------------------------------------------------------------------------------------------

#: Kinds of objects, those whose text is opaque, and the folder of each kind.
MODULE_KINDS = ["VIEW", "FUNCTION", "PROCEDURE", "TRIGGER"]
FOLDERS = {
    "SCHEMA": "schemas", "TYPE": "types", "SEQUENCE": "sequences", "TABLE": "tables", "SYNONYM": "synonyms", "VIEW": "views", "FUNCTION": "functions",
    "PROCEDURE": "procedures", "TRIGGER": "triggers",
}


def fold(name: Column) -> Column:
    """Names are kept as written and compared folded: lower case, and the two sharp s as 'ss' as case folding has it."""
    return F.lower(F.regexp_replace(name, "[ßẞ]", "ss"))


def quote(name: Column) -> Column:
    """[name] with closing brackets doubled; null for an empty name, which has no quoted form."""
    return F.when(name != "", F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]")))


def qualified(schema: Column, name: Column) -> Column:
    return F.concat(quote(schema), F.lit("."), quote(name))


def sql_literal(text: Column) -> Column:
    """N'...' with quotes doubled; null for text that would not arrive as written (NUL, a backslash before a line break)."""
    return F.when(~text.rlike("\\x00|\\\\[\\r\\n]"), F.concat(F.lit("N'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))


def object_key(kind: Column, schema: Column, name: Column) -> Column:
    """KIND:[schema].[name]; a schema's key has one part.  Null for an unknown kind or parts that don't fit it."""
    own = F.when(kind == "SCHEMA", F.when(schema.isNull(), quote(name))).otherwise(qualified(schema, name))
    return F.when(kind.isin(*FOLDERS), F.concat(kind, F.lit(":"), own))


_PART = r"\[((?:[^\]]|\]\])+)\]"


def key_parts(key: Column) -> Column:
    """struct<kind, schema, name> of an object key; null for any other text."""
    one, two = rf"^(SCHEMA):{_PART}$", rf"^({'|'.join(k for k in FOLDERS if k != 'SCHEMA')}):{_PART}\.{_PART}$"
    plain = lambda c: F.replace(c, F.lit("]]"), F.lit("]"))
    part = lambda pattern, i: plain(F.regexp_extract(key, pattern, i))
    none = F.lit(None).cast("string")
    return F.when(key.rlike(one), F.struct(part(one, 1).alias("kind"), none.alias("schema"), part(one, 2).alias("name"))).when(
        key.rlike(two), F.struct(part(two, 1).alias("kind"), part(two, 2).alias("schema"), part(two, 3).alias("name")))


#: Characters that a file name can't hold, and names of devices that are no files.
_UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
_DEVICE = r"(?i)^(con|prn|aux|nul|conin\$|conout\$|(?:com|lpt)[0-9¹²³]) *(?:[.:]|$)"
MAX_FILE_NAME = 255


def file_name_problem(name: Column) -> Column:
    """empty, unsafe character, ends with dot or space, device name, too long; null for a good name."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty").when(name.rlike(_UNSAFE), "unsafe character").when(name.rlike("[. ]\\z"), "ends with dot or space")
        .when(name.rlike(_DEVICE), "device name").when(F.octet_length(name) > MAX_FILE_NAME, "too long"))


def path_problem(path: Column) -> Column:
    """The first problem of a path's parts; of an .sql file the name without it has to be good as well."""
    stem = lambda p: F.when(p.endswith(".sql"), F.coalesce(file_name_problem(F.regexp_replace(p, "\\.sql\\z", "")), file_name_problem(p))).otherwise(file_name_problem(p))
    return F.get(F.filter(F.transform(F.split(path, "/", -1), stem), lambda p: p.isNotNull()), F.lit(0))


def path_for(kind: Column, schema: Column, name: Column) -> Column:
    """schema/<folder>/<schema>.<name>.sql; null where the name can't be a file's."""
    folder = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])[kind]
    stem = F.when(kind == "SCHEMA", name).otherwise(F.concat(schema, F.lit("."), name))
    return F.when(path_problem(F.concat(stem, F.lit(".sql"))).isNull(), F.concat(F.lit("schema/"), folder, F.lit("/"), stem, F.lit(".sql")))


def key_for_path(path: Column) -> Column:
    """struct<kind, stem> of an object file's path, null for others."""
    kinds = F.create_map(*[F.lit(x) for k, v in FOLDERS.items() for x in (v, k)])
    shape = r"^schema/([a-z]+)/([^/]+)\.sql$"
    kind, stem = kinds[F.regexp_extract(path, shape, 1)], F.regexp_extract(path, shape, 2)
    return F.when(path.rlike(shape) & kind.isNotNull() & path_problem(F.concat(stem, F.lit(".sql"))).isNull(), F.struct(kind.alias("kind"), stem.alias("stem")))


def glob_part(pattern: str) -> str:
    """A regular expression for one part of a pattern: * and ? are wildcards, all else stands for itself."""
    return "(?is)\\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "\\z"


def glob_matches(pattern: str, schema: Column, name: Column) -> Column:
    """A pattern 'schema.name' is split at its first dot and each part matches its own name, which may hold dots."""
    owner, _, rest = pattern.partition(".")
    return fold(schema).rlike(glob_part(owner.lower())) & fold(name).rlike(glob_part(rest.lower()))


# ---- texts -----------------------------------------------------------------------------------------------------

def plain_lines(text: Column) -> Column:
    """One leading BOM dropped, CR LF and CR to LF."""
    return F.regexp_replace(F.regexp_replace(text, f"\\A{BOM}", ""), "\r\n?", "\n")


def normal_form(text: Column) -> Column:
    """`plain_lines`, then blanks, tabs, vertical tabs and form feeds dropped at line ends, and empty lines at the end."""
    return F.regexp_replace(F.regexp_replace(plain_lines(text), "[ \\t\\x0B\\f]+\\n", "\n"), "[ \\t\\x0B\\f\\n]+\\z", "")


def checksum(text: Column) -> Column:
    """sha256 of the normal form, lower-case hexadecimal; null stays null."""
    return F.sha2(normal_form(text).cast("binary"), 256)


def file_checksum(text: Column) -> Column:
    """sha256 of the text with plain lines, as a log of files holds it."""
    return F.sha2(plain_lines(text).cast("binary"), 256)


# ---- error messages --------------------------------------------------------------------------------------------

#: Masks, the longest stored message, and white space as text functions split it.
REDACTED, HIDDEN, MESSAGE = "<redacted>", "<hidden>", 300
_BLANK = r"[\s\x1c-\x1f\u0085   -     　]+"
#: Messages that print names only.  NAME: one to four parts; KIND: a word for a schema object.
CATALOG_MESSAGES = [
    "The operation failed because an index or statistics with name 'NAME' already exists on KIND 'NAME'.",
    "There is already an object named 'NAME' in the database.",
    "Could not drop object 'NAME' because it is referenced by a FOREIGN KEY constraint.",
    "The KIND 'NAME' is dependent on KIND 'NAME'.",
]
STATEMENT_MESSAGES = [
    "Invalid column name 'NAME'.",
    "Invalid object name 'NAME'.",
    "Column names in each table must be unique. Column name 'NAME' in table 'NAME' is specified more than once.",
    "Cannot drop the KIND 'NAME', because it does not exist or you do not have permission.",
    'Cannot find the object "NAME" because it does not exist or you do not have permissions.',
]
_KIND = "(?:table|view|procedure|function|trigger|index|statistics|constraint|column|type|schema|synonym|sequence object|object|default|rule)"
_IN_NAME = r"(?: |[^'\"().\s\x00-\x1f\x7f-\x9f؜​-‏ -‮⁠-⁯﻿￹-￻]){1,128}"
_LAYERS = r"(?:\[Microsoft\](?:\[ODBC Driver \d+ for SQL Server\])?\[SQL Server\])?"


def _message(template: str) -> str:
    escaped = re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", template)
    return "(?s)\\A" + _LAYERS + escaped.replace("NAME", f"({_IN_NAME}(?:\\.{_IN_NAME}){{0,3}})").replace("KIND", _KIND) + "\\z"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def redact(text: Column, written: Column | None = None) -> Column:
    """A message without values, on one line of at most MESSAGE characters.

    A message of names alone keeps them: names of the catalog always, names that a statement wrote if each part is in
    `written` (an array of the identifiers of that statement).  Else values after the two phrases that print rows,
    quoted parts and parentheses give way to a mask; a quote or parenthesis without an end hides the rest.  Pairs are
    replaced from the inside until none is left, however deep.
    """
    whole = F.regexp_replace(text, f"\\A{_BLANK}|{_BLANK}\\z", "")
    keeps = F.lit(False)
    for template in CATALOG_MESSAGES:
        keeps = keeps | whole.rlike(_message(template))
    if written is not None:
        for template in STATEMENT_MESSAGES:
            pattern = _message(template)
            parts = F.flatten(F.array(*[F.split(F.regexp_extract(whole, pattern, i + 1), r"\.") for i in range(template.count("NAME"))]))
            keeps = keeps | (whole.rlike(pattern) & (F.size(F.array_except(parts, F.coalesce(written, F.array().cast("array<string>")))) == 0))
    out = F.regexp_replace(text, r"(?is)(The duplicate key value is|Truncated value:).*", f"$1 {REDACTED}")
    out = F.regexp_replace(out, r"'(?:[^']|'(?=\w))*(?:'|\z)", REDACTED)
    out = F.regexp_replace(out, r'"[^"]*(?:"|\z)', REDACTED)

    def step(state: Column, _: Column) -> Column:
        again = let(F.regexp_replace(state["t"], r"\([^()]*\)", REDACTED), lambda t: F.struct(t.alias("t"), (t != state["t"]).alias("more")))
        return F.when(state["more"], again).otherwise(state)

    # each round takes one level of nesting, of which there are at most as many as opening parentheses
    opens = F.length(out) - F.length(F.replace(out, F.lit("("), F.lit("")))
    start = F.struct(out.alias("t"), F.lit(True).alias("more"))
    inside = F.when(opens > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(opens, F.lit(1))), start, step)["t"]).otherwise(out)
    masked = squeezed(F.regexp_replace(inside, r"(?s)\(.*", REDACTED))
    return F.substring(F.when(keeps, whole).otherwise(masked), 1, MESSAGE)


#: Numbers that decide a reaction.
TRANSIENT_AT_CONNECT = [40613, 40197, 40501, 49918, 49919, 49920, 10928, 10929, 4060]
GOVERNANCE = [40552, 9002, 40549, 40550, 40551, 40544]
LOCK_TIMEOUT, DEADLOCK = 1222, 1205
#: Messages that have a number, the first that fits counts.
KNOWN_MESSAGES = [
    (207, r"Invalid column name '"),
    (208, r"Invalid object name '"),
    (245, r"Conversion failed when converting the .* value '.*' to data type"),
    (2601, r"Cannot insert duplicate key row in object '.*' with unique index '"),
    (2627, r"Violation of (?:PRIMARY|UNIQUE) KEY constraint '.*'\. Cannot insert duplicate key in object"),
    (3729, r"Cannot ALTER '.*' because it is being referenced by object '"),
    (3998, r"Uncommittable transaction is detected at the end of the batch"),
    (2714, r"There is already an object named '.*' in the database"),
    (2020, r'The dependencies reported for entity ".*" might not include references to all columns'),
    (1222, r"Lock request time out period exceeded"),
    (1205, r"was deadlocked on .* resources with another process and has been chosen as the deadlock"),
    (4060, r'Cannot open database ".*" requested by the login'),
    (40613, r"Database '.*' on server '.*' is not currently available"),
    (40197, r"The service has encountered an error processing your request\. Please try again"),
    (40501, r"The service is currently busy\. Retry the request after \d+ seconds"),
    (49918, r"Cannot process request\. Not enough resources to process request"),
    (49919, r"Cannot process create or update request\. Too many create or update operations"),
    (49920, r"Cannot process request\. Too many operations in progress for subscription"),
    (10928, r"Resource ID ?: ?\d+\. The .* limit for the database is \d+ and has been reached"),
    (10929, r"Resource ID ?: ?\d+\. The .* minimum guarantee is \d+, maximum limit is \d+"),
    (40552, r"session has been terminated because of excessive transaction log space usage"),
    (9002, r"The transaction log for database '.*' is full due to"),
    (40549, r"Session is terminated because you have a long[- ]running transaction"),
    (40550, r"session has been terminated because it has acquired too many locks"),
    (40551, r"session has been terminated because of excessive TEMPDB usage"),
    (40544, r"The database '.*' has reached its size quota"),
    (18456, r"Login failed for user '"),
]
#: Shapes in which a number is written in a message.
NUMBER_SHAPES = [r"(?i)\bMsg (\d+), Level \d+", r"\((\d+)\) \(SQL[A-Za-z]+\)", r"\[[0-9A-Z]{5}\] \((\d+)\)", r"\((\d+)\)\s*\z"]
CONNECT_TIMEOUT = "TCP Provider: Timeout error"


def known_number(text: Column) -> Column:
    """The number of a message that is known by its words, else null."""
    flat = squeezed(text)
    out = F.lit(None).cast("int")
    for number, pattern in reversed(KNOWN_MESSAGES):
        out = F.when(flat.rlike(f"(?i){pattern}"), number).otherwise(out)
    return out


def parse_number(text: Column) -> Column:
    """A number above 0 that is written in the message, else the known one."""
    written = [F.regexp_extract(text, shape, 1).try_cast("int") for shape in NUMBER_SHAPES]
    return F.coalesce(*[F.when(n > 0, n) for n in written], known_number(text))


def error_class(number: Column, state: Column, text: Column, at_connect: Column) -> Column:
    """The class that selects the reaction; without a number a known message gives it."""
    n = F.coalesce(number, known_number(text))
    transient = at_connect & (n.isin(TRANSIENT_AT_CONNECT) | (n.isNull() & text.contains(CONNECT_TIMEOUT)))
    return (
        F.when(n.isin(GOVERNANCE), "governance").when(n == LOCK_TIMEOUT, "lock_timeout").when(n == DEADLOCK, "deadlock")
        .when(transient, "transient_connect").when(state.startswith("08") | (state == "40003"), "session_lost").otherwise("other")
    )


# ---- secrets ---------------------------------------------------------------------------------------------------

#: A credential word given a literal; and the wider rule for text that nobody has reviewed.
SECRET = r"(?i)(?<![\w@#$])(password|secret)\s*=\s*(?:N?'|0x[0-9a-f])"
SECRET_LIVE = (
    r"(?i)(?:password|passwd|pwd|secret|passphrase)\w*[\]\"]?(?:\s+(?:AS\s+)?\[?[a-z_]+\]?(?:\s*\([^)]*\))?)?\s*=\s*\(?\s*(?:N?'|0x[0-9a-f])"
    r"|(?:password|pwd)=[^\s;'\"@]|(?:EN|DE)CRYPTBYPASSPHRASE\s*\(\s*N?'")


def secret_in_text(text: Column) -> Column:
    """A literal that looks like a credential anywhere in the text; null texts hold none."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(SECRET) | t.rlike(SECRET_LIVE)


def secret_lines(text: Column) -> Column:
    """array<int>: lines of the narrow rule's hits, read as text."""
    lines = F.split(plain_lines(text), "\n")
    return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike(SECRET))


#: Fixed value: the keywords of a connection string that a login or password follows.
_SIGN_IN = r"(?i)\b(?:pwd|uid|password|user id)\s*="


def hide_sign_in(text: Column, login: str = "", password: str = "") -> Column:
    """A login (as a whole word) and a password (anywhere) taken out, each as it is, with } doubled, and so in braces.
    Places that overlap or touch become one mask."""
    forms: dict[str, bool] = {}
    for value, word in ((password, False), (login, True)):
        if value:
            doubled = value.replace("}", "}}")
            for form, alone in (("{" + doubled + "}", False), (doubled, word), (value, word)):
                forms.setdefault(form, alone)
    if not forms:
        return text
    span = lambda n: lambda p: F.struct(p.alias("a"), (p + n).alias("b"))
    spans = F.concat(*[F.transform(_places(text, form, word), span(len(form))) for form, word in forms.items()])
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (s["a"] <= last["b"])
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(touches, merged).otherwise(F.concat(done, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

    places = F.aggregate(F.array_sort(spans), empty, join)

    def cut(ps: Column) -> Column:
        piece = lambda i: F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.get(ps, i - 1)["b"]) + 1,
                                      F.when(i == F.size(ps), F.length(text)).otherwise(F.get(ps, i)["a"]) - F.when(i == 0, F.lit(0)).otherwise(F.get(ps, i - 1)["b"]))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ps)), piece), HIDDEN)

    return F.when(F.size(places) > 0, let(places, cut)).otherwise(text)


def _places(text: Column, form: str, word: bool) -> Column:
    """0-based places of a form, also such that overlap; of a word only where no word character stands beside it."""
    n = len(form)
    at = F.sequence(F.lit(0), F.length(text))

    def here(p: Column) -> Column:
        found = F.substring(text, p + 1, F.lit(n)) == form
        if word and re.match(r"\w", form):
            found = found & ((p == 0) | ~F.substring(text, p, F.lit(1)).rlike(r"\w"))
        if word and re.search(r"\w\Z", form):
            found = found & ~F.substring(text, p + n + 1, F.lit(1)).rlike(r"\w")
        return found

    return F.filter(at, here)


def hide_echo(text: Column, login: str = "", password: str = "") -> Column:
    """`hide_sign_in`, and what follows a keyword of a connection string goes too: a cut value can't be found by its text."""
    if not login and not password:
        return text
    return F.regexp_replace(hide_sign_in(text, login, password), f"(?s){_SIGN_IN}.*", HIDDEN)


# ---- values of logs and reports --------------------------------------------------------------------------------

STRING, ITEMS = 500, 200


def batch_tag(batch: Column, prefix: str) -> Column:
    """The name inside a leading /* prefix:name */ comment, else null."""
    found = F.regexp_extract(batch, rf"\A[ \t\r\n{BOM}]*/\*\s*{re.escape(prefix)}:([A-Za-z0-9_.-]+)\s*\*/", 1)
    return F.when(found != "", found)


def flat(text: Column) -> Column:
    """One printable line, cut at STRING characters."""
    return F.substring(squeezed(F.regexp_replace(text, r"[\p{C}\p{Z}]", " ")), 1, STRING)


def clean_items(items: Column) -> Column:
    """At most ITEMS strings of at most STRING characters."""
    return F.transform(F.slice(items, 1, ITEMS), lambda x: F.substring(x, 1, STRING))


def cell(text: Column) -> Column:
    """A value in a table of a Markdown report: one line, bars and backslashes escaped."""
    return F.regexp_replace(squeezed(F.coalesce(text, F.lit(""))), r"([\\|])", r"\\$1")


def span_seconds(first: Column, last: Column) -> Column:
    """'12.3 s' between two ISO instants, 'unknown' if one isn't one."""
    a, b = F.try_to_timestamp(first), F.try_to_timestamp(last)
    seconds = (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)
    return F.coalesce(F.concat(seconds.cast("decimal(20,1)").cast("string"), F.lit(" s")), F.lit("unknown"))


# ---- types and small values ------------------------------------------------------------------------------------

#: Units of a retention by their code.
RETENTION = {3: "DAYS", 4: "WEEKS", 5: "MONTHS", 6: "YEARS"}


def retention(period: Column, unit: Column) -> Column:
    """struct<n, unit>; null for an infinite one (-1 or no period)."""
    name = F.create_map(*[F.lit(x) for pair in RETENTION.items() for x in pair])[unit]
    return F.when((period > 0) & name.isNotNull(), F.struct(period.alias("n"), name.alias("unit")))


def _size(length: Column) -> Column:
    return F.when(length == -1, F.lit(2**31 - 1)).otherwise(F.coalesce(length, F.lit(0)))


def narrower(old: Column, new: Column) -> Column:
    """Types of one name, struct<length, precision, scale> with length -1 for max: a value of the old one may not fit."""
    old_scale, new_scale = F.coalesce(old["scale"], F.lit(0)), F.coalesce(new["scale"], F.lit(0))
    digits = F.coalesce((new["precision"] - new_scale) < (old["precision"] - old_scale), F.lit(False))
    return (_size(new["length"]) < _size(old["length"])) | (new_scale < old_scale) | digits


def only_widens(old: Column, new: Column) -> Column:
    """One of the variable-length types that only gets longer: name and all else as before."""
    variable = old["name"].isin("varchar", "nvarchar", "varbinary")
    return variable & (old["name"] == new["name"]) & (_size(new["length"]) > _size(old["length"]))


def type_text(name: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """A type's declaration from its catalog row: bytes to characters for two-byte types, -1 to max, a vector's bytes to its
    numbers, precision and scale where the type has them."""
    chars = F.when(max_length == -1, "max").when(name.isin("nchar", "nvarchar"), (max_length / 2).cast("int").cast("string")).otherwise(max_length.cast("string"))
    argument = (
        F.when(name.isin("char", "varchar", "nchar", "nvarchar", "binary", "varbinary"), chars)
        .when(name.isin("decimal", "numeric"), F.concat(precision.cast("string"), F.lit(", "), scale.cast("string")))
        .when(name.isin("time", "datetime2", "datetimeoffset"), scale.cast("string"))
        .when(name == "vector", ((max_length - 8) / 4).cast("int").cast("string")))
    return F.when(argument.isNull(), name).otherwise(F.concat(name, F.lit("("), argument, F.lit(")")))


def mask_spelling(function: Column, scale: Column) -> Column:
    """A masking call in stored spelling: name in lower case, ', ' between arguments, whole numbers without leading zeros,
    and for random() on a decimal the column's scale."""
    name = F.lower(F.regexp_extract(function, r"(?s)\A([A-Za-z_]+)[ \t]*\((.*)\)\z", 1))
    inside = F.regexp_extract(function, r"(?s)\A([A-Za-z_]+)[ \t]*\((.*)\)\z", 2)
    raw = F.regexp_extract_all(inside, F.lit(r'"(?:[^"]|"")*"|[^,"\s][^,"]*'), F.lit(0))

    def argument(a: Column) -> Column:
        t = F.trim(a)
        whole = F.regexp_replace(t, r"\A(-?)0+(?=[0-9])", "$1")
        decimals = F.when(scale.isNotNull() & (name == "random") & t.rlike(r"\A-?[0-9]+(\.[0-9]*)?\z"), F.concat(
            F.regexp_extract(whole, r"\A(-?[0-9]+)", 1), F.when(scale > 0, F.concat(F.lit("."), F.rpad(F.regexp_extract(whole, r"\.([0-9]*)", 1), scale, "0"))).otherwise("")))
        return F.when(t.startswith('"'), t).otherwise(F.coalesce(decimals, F.when(t.rlike(r"\A-?[0-9]+\z"), whole).otherwise(t)))

    done = F.concat(name, F.lit("("), F.array_join(F.transform(raw, argument), ", "), F.lit(")"))
    return F.when(name != "", done).otherwise(function)


def trigger_events(text: Column) -> Column:
    """'INSERT:0:1;UPDATE:1:0' as map<event, struct<first, last>>."""
    entry = lambda e: F.struct(F.split(e, ":")[0], F.struct((F.split(e, ":")[1] == "1").alias("first"), (F.split(e, ":")[2] == "1").alias("last")))
    return F.map_from_entries(F.transform(F.filter(F.split(text, ";"), lambda e: e != ""), entry))


def merged(left: Column, right: Column) -> Column:
    """Two maps in one; the right side wins."""
    own = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(own, right)


def first_kept(items: Column) -> Column:
    """Items once each, in the order of their first places."""
    return F.array_distinct(items)


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII written as \\uXXXX (pairs beyond the basic plane)."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        high, low = F.lit(0xD800) + F.floor((n - 0x10000) / 1024), F.lit(0xDC00) + (n - 0x10000) % 1024
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high.cast("int")), unit(low.cast("int"))))

    return F.when(text.rlike(r"\A[\x00-\x7f]*\z"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def canonical_json(*names: str) -> Column:
    """Keys in alphabetical order, no spaces, nulls written."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def required_flag(value: Column, name: str) -> Column:
    """A flag that must be known: null ends the query instead of passing for false."""
    return F.when(value.isNotNull(), value.cast("boolean")).otherwise(F.raise_error(F.lit(f"{name} is null")).cast("boolean"))
