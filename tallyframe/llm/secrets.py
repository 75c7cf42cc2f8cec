"""Secret scan with a random forest that removes false positives; DataFrame and SQL functions only.

Scan: candidates are (key characters are letters, digits, ``_ + / = -``)
 - the body of a PEM block: 16 or more of letters, digits, ``+ / =``, white space and backslashes between BEGIN and END lines;
 - 6 or more characters without white space after ``Authorization`` (assigned) and ``Basic`` or ``Bearer``;
 - the password of a URL: 3 to 200 characters between ``://user:`` and ``@``;
 - runs of 20 or more key characters;
 - after NAME= or NAME: (quotes and spaces may stand between), 8 or more key characters;
 - after such a name with a credential word in it, 4 or more characters that are neither white space nor quotes, or
   that stand between quotes in one line (200 at most);
 - 6 or more characters without white space after a credential word and spaces (``is``, ``was``, ``to`` or ``as`` may stand between).
Of kinds that begin at the same place the first listed wins, named values before runs. A name is not assigned a PEM block.
A name in front of an assignment belongs to the text before its value, and is a candidate itself from 20 characters.
Nothing else is a candidate: shorter strings, and those of under 20 key characters without name or credential word.
``found`` alone, unless ``wide``, gives runs of 20 or more key characters with a digit. Each candidate is taken with
up to 60 characters before and 30 after it. Candidates are found by splitting texts, so every place of every text is
seen, and a text of any length takes time in proportion to it.

Features: length; transitions between character classes (lower, upper, digit, other) and the share of each class;
number of distinct characters; dictionary coverage (share of the candidate's characters that are made up of common
identifier and prose words, or of the text around it); path (slashes, a file ending, a URL or directory before it); how services' credentials, references and placeholders begin;
neighbouring words (credential words, assignment, quotes, a PEM header of a private key, an authorization scheme, the
login of a URL; words that speak against, such as commit, checksum, uuid, example).

Forest: ``pyspark.ml`` trees trained on labelled findings, at most ``max_rows`` of them; the default set is built by
rules from hashes (credentials in many phrasings; checksums, ids, paths, identifiers and placeholders).

Null text counts as empty: no findings. Null paths (the ``source`` column) count as empty. Repeated rows are scanned
each; equal candidates in one text are separate findings. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MIN_LENGTH = 20
#: Of what is assigned to any name, to a name with a credential word, and of what a credential word and spaces precede.
MIN_ASSIGNED, MIN_NAMED, MIN_TOLD = 8, 4, 6
MAX_ROWS = 20_000
ACCEPT = 0.5
BEFORE, AFTER = 60, 30
#: Parts of a text whose lengths are added up together.
BLOCK = 64

# Word lists.
CREDENTIAL_WORDS = "token secret password passwd pwd credential credentials apikey api_key key auth authorization bearer private access_key secret_key client_secret".split()
AGAINST_WORDS = "commit sha sha1 sha256 md5 checksum digest etag uuid guid revision blob tree hash integrity example sample placeholder dummy test fixture build version".split()
DICTIONARY = """
access account action address after app array auto back base batch begin block body buffer build byte call change
check class client close code color command commit common config connect content control count create current data
date debug default delete device dir document domain down enable error event example factory file filter find float
folder format from function get handle hash header host http import index init input item java job json key label link
list load local lock log long main master member message meta method model module name network number object open
option order output override page password path pattern placeholder port print private process profile property
provider public query read record report request response result return right screen search send server service
session set source start state status step store stream string style support switch system table target template test
the true type undefined update upload url user util utils value version web width window with word xml
""".split()

#: How credentials of well-known services begin.
VENDOR = "^(?:gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|sk-|pk_live_|xox[abprs]-|AKIA|ASIA|AIza|npm_|pypi-|hf_|SG[.]|ya29[.]|eyJ)"

PROSE = "performance following generated important requirements mandatory incorrect management exchange protected expired required strategies different winter orange monkey dragon horse battery silver garden purple planet coffee guitar rocket tiger".split()

_KEY_CHARS = "A-Za-z0-9_+/=-"
#: A candidate is set between these while the text is split; neither is a key character.
_MARK = "\u0001"


def _wide() -> tuple[str, str]:
    """Pattern of the candidates with what leads to them, and its replacement with marks: long name, lead, candidate, rest."""
    words = "|".join(sorted((w.replace("_", "[_-]?") for w in CREDENTIAL_WORDS), key=len, reverse=True))
    key, quote = f"[{_KEY_CHARS}]", "[\"'`]"
    gap = f"{quote}?\\s{{0,3}}(?::=|=>|==?|:(?!//))\\s{{0,3}}{quote}?"
    start = f"(?<![.{_KEY_CHARS}])"
    name, long_name = f"{start}[A-Za-z_][A-Za-z0-9_.-]{{0,18}}+", f"{start}[A-Za-z_][A-Za-z0-9_.-]{{19,63}}+"
    credential = f"(?<=(?i:{words})[A-Za-z0-9_.-]{{0,20}}(?:{quote}?\\s{{0,3}}(?::=|=>|==?|:)\\s{{0,3}}{quote}?))"
    bare = "[^\\s\"'`]"
    end = "[^\\s\"'`,;.)\\]}]"
    value = f"{credential}(?:(?<={quote})[^\"'`\\r\\n]{{{MIN_NAMED},200}}+(?={quote})|{bare}{{{MIN_NAMED - 1},}}{end})|{key}{{{MIN_ASSIGNED},}}+"
    told = f"(?<![A-Za-z])(?i:{words})\\s{{1,3}}(?:(?:is|was|to|as)\\s{{1,3}})?{quote}?"
    block = "-----BEGIN [A-Z0-9 ]{1,40}-----"
    end_line = "-----END [A-Z0-9 ]{1,40}-----"
    body = f"[A-Za-z0-9+/=\\s\\\\]{{16,}}+(?={end_line})"
    scheme = f"{start}(?:[A-Za-z-]{{1,20}}-)?(?i:authorization){quote}?\\s{{0,3}}[:=]\\s{{0,3}}{quote}?(?i:basic|bearer)\\s{{1,3}}"
    login = "://[^\\s/:@\"'`]{0,64}+:"
    password = "[^\\s/@\"'`]{3,200}+(?=@)"
    no_block = "(?!-----BEGIN )"
    # (what leads to a candidate, candidate)
    kinds = [
        (block, body),
        (scheme, f"{bare}{{{MIN_TOLD - 1},}}{end}"),
        (login, password),
        (name + gap + no_block, value),
        ("", f"(?<!{key}){key}{{{MIN_LENGTH},}}+"),
        (told, f"{bare}{{{MIN_TOLD - 1},}}{end}"),
    ]
    # a long name is a candidate of its own; an END line stays with what follows its block
    pattern = "|".join([f"({lead})({c})({end_line})" if lead is block else f"({lead})({c})" for lead, c in kinds[:3]] + [f"({long_name})({gap}{no_block})({value})"] + [f"({lead})({c})" for lead, c in kinds[3:]])
    return pattern, f"{_MARK}$8{_MARK}$1$4$6$9$11$13$15{_MARK}$2$5$7$10$12$14$16{_MARK}$3"


def found(docs: DataFrame, path: str = "source", wide: bool = False) -> DataFrame:
    """doc_id, path, start (code points from 0), candidate, and the text before and after it."""
    text = F.coalesce("text", F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    text = F.translate(text, _MARK, " ")
    marked = F.regexp_replace(text, *map(F.lit, _wide())) if wide else F.regexp_replace(text, f"(?<![{_KEY_CHARS}])([{_KEY_CHARS}]{{{MIN_LENGTH},}}+)", f"{_MARK}$1{_MARK}")
    # odd parts are candidates, even ones what lies between them
    every = docs.select("doc_id", where.alias("path"), F.inline(_let(F.split(marked, _MARK), _hits)))
    return every.filter("candidate <> ''") if wide else every.filter(F.col("candidate").rlike("[0-9]"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits(parts: Column) -> Column:
    """Start, text and surroundings of every odd part; starts are sums over blocks of parts and inside one block."""
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    add = lambda n: F.aggregate(n, F.lit(0), lambda a, x: a + x)

    def of(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        firsts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return _let(firsts, lambda first: hits(lengths, first))

    def hits(lengths: Column, first: Column) -> Column:
        def hit(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.struct(
                (F.get(first, block) + add(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK))).alias("start"),
                F.get(parts, i).alias("candidate"),
                # a name before an assignment is a part of its own
                F.right(F.concat(part(i - 3), part(i - 2), part(i - 1)), F.lit(BEFORE)).alias("before"),
                F.left(F.concat(part(i + 1), part(i + 2), part(i + 3)), F.lit(AFTER)).alias("after"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), hit)

    return F.when(F.size(parts) > 2, _let(F.transform(parts, F.length), of))


def _any(words: list[str]) -> str:
    return "(?i)(?<![A-Za-z])(?:" + "|".join(words) + ")(?![A-Za-z])"


def _share(part: Column, whole: Column) -> Column:
    return (part / F.greatest(whole, F.lit(1))).cast("double")


FEATURES = {
    "n": lambda c, b, a, p: F.length(c).cast("double"),
    "transitions": lambda c, b, a, p: _share(F.length(F.regexp_replace(_classes(c), r"(.)\1+", "$1")) - 1, F.length(c) - 1),
    "lower": lambda c, b, a, p: _share(F.length(F.regexp_replace(c, "[^a-z]", "")), F.length(c)),
    "upper": lambda c, b, a, p: _share(F.length(F.regexp_replace(c, "[^A-Z]", "")), F.length(c)),
    "digit": lambda c, b, a, p: _share(F.length(F.regexp_replace(c, "[^0-9]", "")), F.length(c)),
    "hex": lambda c, b, a, p: _share(F.length(F.regexp_replace(c, "[^0-9a-f]", "")), F.length(c)),
    "distinct": lambda c, b, a, p: _share(F.size(F.array_distinct(F.split(c, ""))), F.least(F.length(c), F.lit(64))),
    "dictionary": lambda c, b, a, p: 1 - _share(F.length(F.regexp_replace(F.lower(c), "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")), F.length(c)),
    "slashes": lambda c, b, a, p: _share(F.length(F.regexp_replace(c, "[^/]", "")), F.length(c)),
    "joined": lambda c, b, a, p: _share(F.length(F.regexp_replace(c, "[^_-]", "")), F.length(c)),
    "uuid": lambda c, b, a, p: c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("double"),
    "vendor": lambda c, b, a, p: c.rlike(VENDOR).cast("double"),
    "reference": lambda c, b, a, p: (c.rlike(r"^[$<{%]") | c.rlike(r"^[A-Za-z_]+(?:\.[A-Za-z_]+)+\(?") | c.rlike("(?i)(?:your|here|change|example|placeholder|x{4}|dummy)")).cast("double"),
    "in_path": lambda c, b, a, p: (b.rlike(r"(?:://|www\.|[./\\])[^\s\"']*$") | a.rlike(r"^\.[A-Za-z]{2,4}(?![A-Za-z])")).cast("double"),
    "file_path": lambda c, b, a, p: p.rlike(r"(?i)(?:test|fixture|example|mock|\.lock$|\.sum$|\.svg$|\.map$)").cast("double"),
    "key_word": lambda c, b, a, p: F.right(b, F.lit(40)).rlike(_any(CREDENTIAL_WORDS) + "|(?<=[a-z])(?:Key|Token|Secret|Password|Credential)(?![a-z])|(?<![a-z])(?:secret|token|password|auth)(?=[A-Z])").cast("double"),
    "against": lambda c, b, a, p: F.right(b, F.lit(40)).rlike(_any(AGAINST_WORDS)).cast("double"),
    "assigned": lambda c, b, a, p: b.rlike(r"[:=]\s*[\"'`]?$").cast("double"),
    "pem": lambda c, b, a, p: b.rlike(r"-----BEGIN [A-Z0-9 ]{0,33}PRIVATE KEY(?: BLOCK)?-----$").cast("double"),
    "scheme": lambda c, b, a, p: b.rlike(r"(?i)(?<![a-z])(?:basic|bearer)\s+$").cast("double"),
    "url_login": lambda c, b, a, p: (b.rlike("://[^\\s/:@\"'`]*:$") & a.startswith("@")).cast("double"),
    "quoted": lambda c, b, a, p: (b.rlike("[\"'`]$") & a.rlike("^[\"'`]")).cast("double"),
}


def _classes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[0-9]", "\u0004"), "[_+/=-]", "\u0005")


def with_features(rows: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("candidate", "before", "after", "path")]
    return rows.select("*", *(f(*cols).alias(f"f_{name}") for name, f in FEATURES.items()))


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """A labelled set made by rules: path, candidate, before, after, is_secret; near half of it secrets."""
    rows = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("finding"), F.col("id")), 512))
    rows = rows.withColumn("b64", F.translate(F.base64(F.unhex("h")), "=\r\n", "")).withColumn("k", F.pmod(F.hash("id"), F.lit(1000)))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), F.pmod(F.hash("id", F.lit(salt)), F.lit(len(words))) + 1)
    hex_of = lambda n: F.substring("h", 1, n)
    b64_of = lambda n: F.concat(F.substring("b64", 2, n - 2), F.lit("7a"))
    ident = F.concat_ws("_", pick(DICTIONARY, 1), pick(DICTIONARY, 2), pick(DICTIONARY, 3), pick(DICTIONARY, 4), F.col("k").cast("string"))
    camel = F.concat(pick(DICTIONARY, 5), *(F.initcap(pick(DICTIONARY, s)) for s in (6, 7, 8, 9)), F.col("k").cast("string"))
    uuid = F.concat_ws("-", *(F.substring("h", a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    words = F.concat_ws(" ", pick(DICTIONARY, 11), pick(DICTIONARY, 12), pick(DICTIONARY, 13))
    names = pick([*CREDENTIAL_WORDS, "secretKey", "apiToken", "dbPassword", "authToken", "app_secret", "user_password", "Authorization: Bearer"], 14)
    assign = pick([" = \"", "=\"", ": \"", "=", ": ", " = '", "\": \""], 15)
    close = F.when(F.pmod(F.hash("id", F.lit(15)), F.lit(7)).isin(3, 4), F.lit("")).when(F.pmod(F.hash("id", F.lit(15)), F.lit(7)) == 5, F.lit("'")).otherwise(F.lit('"'))
    named = F.concat(words, F.lit(" "), names, assign)
    plain = F.concat(words, F.lit(" "))
    against = F.concat(words, F.lit(" "), pick(AGAINST_WORDS, 16), pick([" ", ": ", "=", " \""], 17))
    path = pick(["src1", "src7", "", "app/settings.py", "deploy/prod.env", "notes.md"], 18)
    dull = pick(["src1", "src7", "", "tests/fixture.json", "yarn.lock", "docs/example.md"], 19)
    more = F.concat(F.lit(" "), pick(DICTIONARY, 20))
    shout = F.upper(F.concat_ws("_", pick(DICTIONARY, 31), names))
    letters = F.translate(F.col("b64"), "0123456789+/", "qwhzkTRxvMbG")
    short = F.concat(F.initcap(pick(DICTIONARY, 32)), F.pmod(F.col("k"), F.lit(100)).cast("string"), pick(["x", "!", "#Q", "_z9", "$", "@k"], 33), F.substring("b64", 5, 3))
    told = F.concat(words, F.lit(" "), names, pick([" ", " is ", " \""], 34))
    other = F.concat(words, F.lit(" "), pick(DICTIONARY, 35), pick([": ", " = ", "=", ": \"", " = '"], 36))
    prose = pick(PROSE + [w for w in DICTIONARY if len(w) > 5], 37)
    phrase = F.concat(pick(PROSE, 45), pick(DICTIONARY, 46), pick(PROSE, 47), F.when(F.col("k") % 2 == 0, pick(DICTIONARY, 48)).otherwise(F.lit("")))
    plain_word = F.concat(pick(PROSE, 49), F.pmod(F.col("k"), F.lit(1000)).cast("string"), F.substring(F.translate("h", "0123456789", "ghijklmnop"), 7, 4))
    vendor = pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "AKIA", "npm_", "AIza", "hf_"], 21)
    mixed = F.concat(F.substring("h", 1, 12), F.upper(F.substring("h", 13, 12)), F.substring("h", 25, 12))
    keyed = F.concat(words, F.lit(" "), pick(["cache key ", "primary key ", "partition key ", "sort key ", "row key ", "token count ", "object key "], 50))
    variable = F.upper(F.concat_ws("_", pick(DICTIONARY, 51), names))
    address = pick(["postgres://admin:", "mysql://root:", "redis://:", "mongodb+srv://app:", "https://deploy:", "amqp://svc_user:", "ftp://backup:"], 59)
    host = F.concat(pick(["@db", "@10.0.3.", "@cache", "@host", "@git"], 60), F.pmod(F.col("k"), F.lit(100)).cast("string"), pick([".internal:5432/app", ":6379/0", "/repo.git", ""], 61))
    lower_word = F.concat(pick(PROSE, 62), F.pmod(F.col("k"), F.lit(100)).cast("string"), F.substring(F.translate("h", "0123456789abcdef", "xyzwvutsrqpxyzqw"), 9, 3))
    lines = F.concat(b64_of(64), F.lit("\n"), F.reverse(b64_of(64)), F.lit("\n"), F.substring("b64", 9, 30), F.lit("=\n"))
    scheme = pick(["Authorization: Basic ", "authorization: basic ", "\"Authorization\": \"Basic ", "Proxy-Authorization: Basic ", "Authorization: Bearer "], 63)
    # (secret?, candidate, before, after, path)
    kinds = [
        (1, short, address, host, path),
        (1, F.concat(F.translate(pick(PROSE, 64), "aeo", "430"), F.substring("h", 3, 3)), address, host, path),
        (1, F.substring("b64", 5, 14), address, host, path),
        (1, lower_word, named, close, path),
        (1, F.concat(F.translate(F.substring("b64", 3, 26), "+/", "xQ"), pick(["==", "=", ""], 65)), scheme, pick(["\n", "\"", "", "\r\n"], 66), path),
        (1, lines, pick(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"], 67), F.lit("-----END "), path),
        (0, lines, pick(["-----BEGIN CERTIFICATE-----", "-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE REQUEST-----", "-----BEGIN PGP PUBLIC KEY BLOCK-----"], 68), F.lit("-----END "), path),
        (0, F.concat(F.lit("${"), variable, F.lit("}")), address, host, path),
        (0, pick(["password", "pass", "<password>", "PASSWORD", "[password]", "xxxx", "****", "secret", "{password}", "$PASS"], 69), address, host, path),
        (0, pick(["<credentials>", "<base64>", "authentication", "${TOKEN}", "challenge", "base64(user:password)"], 70), scheme, more, path),
        (1, hex_of(40), named, F.concat(close, more), path),
        (1, hex_of(32), named, F.concat(close, more), path),
        (1, hex_of(64), named, F.concat(close, more), path),
        (1, b64_of(40), named, F.concat(close, more), path),
        (1, b64_of(32), named, close, path),
        (1, F.concat(vendor, mixed), pick(["", "use ", "with ", "export X=", "clone "], 52), more, path),
        (1, phrase, named, close, path),
        (1, plain_word, named, close, path),
        (1, F.concat_ws("-", F.translate(pick(PROSE, 57), "aeio", "4310"), F.substring("h", 3, 4), F.translate(pick(DICTIONARY, 58), "aeio", "4310")), named, close, path),
        (1, F.concat(vendor, b64_of(34)), pick(["", "use ", "token: ", "export X="], 22), more, path),
        (1, b64_of(40), F.concat(words, F.lit(" "), shout, F.lit("=")), more, path),
        (1, hex_of(40), F.concat(pick(["export ", "", "set "], 38), shout, F.lit("=")), more, path),
        (1, short, named, close, path),
        (1, short, told, more, path),
        (1, F.substring("b64", 3, 16), named, close, path),
        (1, hex_of(16), named, close, path),
        (1, F.substring(letters, 3, 32), named, F.concat(close, more), path),
        (0, hex_of(40), against, more, dull),
        (0, hex_of(64), against, more, dull),
        (0, hex_of(40), keyed, more, path),
        (0, F.concat(F.lit("${"), variable, F.lit("}")), named, close, path),
        (0, F.concat(pick(DICTIONARY, 53), F.lit("."), F.when(F.col("k") % 2 == 0, pick(DICTIONARY, 54)).otherwise(variable)), named, pick(["(", "", ",", "()", "["], 55), path),
        (0, F.lit("Bearer"), F.concat(words, pick([" Authorization: ", " auth: ", " authorization = "], 56)), F.concat(F.lit(" "), b64_of(32)), path),
        (0, F.concat(F.lit("YOUR_"), variable, F.lit("_HERE_"), F.col("k").cast("string")), named, close, path),
        (0, prose, told, more, path),
        (0, prose, named, more, path),
        (0, prose, other, more, path),
        (0, F.concat_ws("-", pick(DICTIONARY, 39), pick(DICTIONARY, 40), pick(DICTIONARY, 41), pick(DICTIONARY, 42)), plain, more, dull),
        (0, F.concat(F.lit("20"), F.col("k").cast("string"), F.lit("-10-"), F.substring("h", 1, 2)), other, more, dull),
        (0, F.concat(pick(["<your-", "${", "your_", "changeme_", "example-"], 43), pick(DICTIONARY, 44)), named, close, dull),
        (0, uuid, pick(["id ", "session ", "request_id=", "/objects/"], 23), more, dull),
        (0, ident, pick(["", "call ", "key = ", "self."], 24), more, dull),
        (0, camel, plain, F.lit("("), dull),
        (0, F.concat(F.lit("your_api_key_here_"), F.col("k").cast("string")), named, close, dull),
        (0, F.repeat(pick(["x", "0", "1234", "-", "="], 25), 24), named, close, dull),
        (0, F.concat(pick(DICTIONARY, 26), F.lit("/"), pick(DICTIONARY, 27), F.lit("/"), pick(DICTIONARY, 28), F.lit("/page"), F.col("k").cast("string")), F.lit("see https://host.example/"), F.lit(".html"), dull),
        (0, b64_of(48), pick(["src=\"data:image/png;base64,", "integrity=\"sha384-", "etag: "], 29), F.lit('"'), dull),
        (0, F.concat(F.col("id").cast("string"), F.substring(F.translate("h", "abcdef", "012345"), 1, 20)), pick(["order ", "no ", "id ", "isbn "], 30), more, dull),
    ]
    kind = F.pmod(F.xxhash64("id"), F.lit(len(kinds))).cast("int") + 1
    made = F.array(*(F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"), p.alias("path"), F.lit(y).alias("is_secret")) for y, c, b, a, p in kinds))
    return rows.select(F.element_at(made, kind).alias("finding")).select("finding.*")


def train(findings: DataFrame, max_rows: int = MAX_ROWS, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel | None:
    """A forest over at most ``max_rows`` labelled findings (the smallest hashes); None without any."""
    usable = findings.filter("candidate is not null and is_secret is not null").select("is_secret", *(F.coalesce(c, F.lit("")).alias(c) for c in ("candidate", "before", "after", "path")))
    sample = usable.orderBy(F.xxhash64("candidate", "before", "after", "path", "is_secret"), "candidate", "before").limit(max_rows)
    rows = _assembled(with_features(sample)).select(F.col("is_secret").cast("double").alias("label"), "features").coalesce(1).cache()
    if not rows.take(1):
        return None
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()
    return model


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(rows)


def scan(docs: DataFrame, findings: DataFrame, path: str = "source", accept: float = ACCEPT) -> DataFrame:
    """Every candidate of every text with its probability and whether it is kept as a secret."""
    model = train(findings)
    rows = found(docs, path, wide=True)
    if model is None:  # nothing is known: nothing is removed
        scored = rows.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(_assembled(with_features(rows))).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("candidate")).cast("long").alias("end"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        "probability",
        F.coalesce(F.col("probability") >= accept, F.lit(True)).alias("is_secret"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), labelled_findings(spark))
