"""Secret scans: a random forest removes the false positives among candidates.

A candidate is a run of 16 or more characters of keys and encodings, without the
``NAME=`` that it may begin with, or right after a secret's name and an assignment
or quote a run of 8 or more characters of any kind but white space (and quotes,
where it isn't in other ones), or a web token or other key in parts with its dots, or the password in a
url of 8 characters or more. Names are those of English, German, Spanish and French. Its features are its length, the changes between kinds of characters in it, how much of it a
word list covers, signs of a path around it, and the words beside it. A random
forest trained on labelled findings tells secrets from what only looks like them;
its trees are turned into CASE expressions, so that the scan is one projection of
built-in functions without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

RUN = r"[A-Za-z0-9_+/=\-]"
#: Names before a value in one run, as in ``x=...``: up to the first secret's name, or else all; what follows has 8 characters or more.
_NAME = r"[-_/]*+[A-Za-z]++(?:[0-9]{1,2}[A-Za-z]*+)?(?:[-_/]++[A-Za-z]++(?:[0-9]{1,2}[A-Za-z]*+)?){0,9}+[-_]*+="
BEFORE, AFTER = 40, 16
REDACTED = "<SECRET>"
TREES, DEPTH = 15, 7

# Words that are common inside identifiers, file names and prose.
DICTIONARY = (
    "access account address admin article author backup between branch build change class client code commit config content copy country data "
    "default document download draft email error example file final folder format function general group header history home html http https image "
    "index information item language latest letter level library license line link list local main manager message method model module month name "
    "number object order other page parent password path people place private product profile project public question record release report "
    "request result right script search section secret server service session setting simple source start state status story string style system "
    "table target template test text their there these thing time title token type update upload user value version video view water where which "
    "window with word work world write year the and ing tion ent"
).split()
# Names that stand before a secret, and names that stand before a harmless digest or identifier.
SECRET_WORDS = "tokens?|secrets?|passw(?:or[dt]|d)?|pwd|passphrase|credentials?|(?:api|access|private|secret).?keys?|auth|bearer|kennw(?:ort|örter)|zugangsdaten|geheimnis|(?:api|zugangs).?schl(?:ü|ue)ssel|contrase(?:ñ|n)as?|claves?(?: secreta| de acceso)?|secretos?|credencial(?:es)?|mots? de passe|mdp|cl(?:é|e) (?:secr(?:è|e)te|api|d'acc(?:è|e)s)|jetons?|identifiants?"
#: Between a name and its value in prose, in the languages of the names.
COPULAS = "is|was|ist|lautet|est|es"
HARMLESS_WORDS = "sha.?1|sha.?256|md5|checksum|digest|commit|revision|uuid|guid|etag|integrity|build.?id|isbn|hash"

FEATURES = ("length", "digits", "uppers", "switches", "case_switches", "hex_only", "dictionary", "longest_letters", "slashes", "path_beside", "secret_word", "harmless_word", "assigned", "quoted", "uuid_form", "symbols", "letters_only", "issued", "words")

_SECRET_NAME = rf"(?i:{SECRET_WORDS})[-_]{{0,2}}"
# Between a name and its value: the quote that ends the name, an assignment, the quote that begins the value.
# or the end of the tag that is the name.
_ASSIGNED = r"[\"'`]?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"'`]?+|\s{0,3}[\"'`]|>"
# A url is no value of its own, and a value ends before the next parameter, the next secret's name, the end of its tag and closing punctuation.
_ENDS = rf"</[A-Za-z]|&[\w.\-]{{1,40}}=|{_SECRET_NAME}[\"'`]?\s{{0,3}}[:=]|[.,;:)\]}}>]++(?:[\s\"'`]|\z)"
_VALUE = r"(?![A-Za-z][A-Za-z0-9+.\-]{0,20}://)(?:" + "|".join(rf"{at}(?:(?!{_ENDS})[^\s{quotes}]){{8,}}+" for at, quotes in (('(?<=")', '"'), ("(?<=')", "'"), ("(?<=`)", "`"), ("(?<![\"'`])", "\"'`"))) + ")"
_NAMED = rf"{RUN}*?{_SECRET_NAME}(?:{_ASSIGNED})"
_WEB_TOKEN = r"eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{8,}+){1,4}+"
_USER = r"://[^\s/:@]{0,64}+:"
_IN_URL = rf"{_USER}[^\s/:@]{{8,}}+(?=@)"
# A key in parts of 16 characters or more, after a short head.
_DOTTED = r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{2,}+(?:\.[A-Za-z0-9_\-]{16,}+){1,4}+"
CANDIDATE = rf"(?<!{RUN}){_NAMED}{_VALUE}|{_WEB_TOKEN}|{_IN_URL}|{_DOTTED}|{RUN}{{16,}}"
# What stands right before a secret, or a harmless value, and how an assignment ends.
SECRET_BEFORE = rf"(?i)({SECRET_WORDS})(?:\W{{0,8}}|\W{{1,3}}(?:{COPULAS})\W{{1,4}})\z"
HARMLESS_BEFORE = rf"(?i)({HARMLESS_WORDS})\W{{0,8}}\z"
ASSIGNED_BEFORE = r"(?:[:=]|\w>)\s*[\"']?\z"
NAMES = rf"\A(?:{_NAMED}(?={_VALUE})|(?:{_NAME}){{1,4}}(?=[^=]\S{{7}})|{_USER}|//++(?=[A-Za-z0-9]))"
# How issuers begin their keys.
ISSUED = r"\A(?:gh[opsu]_|github_pat_|glpat-|sk[-_]|pk_live_|xox[abpr]-|AKIA|ASIA|AIza|eyJ)"


def features(candidate: Column, before: Column, after: Column) -> list[Column]:
    """The features of one candidate, as doubles, in the order of ``FEATURES``."""
    n = F.length(candidate).cast("double")
    lower = F.lower(candidate)
    uncovered = F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    without_letters = F.length(F.regexp_replace(candidate, "[A-Za-z]{5,}", ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda p: F.regexp_count(candidate, F.lit(p)).cast("double")
    return [
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
        count("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n,
        flag(candidate.rlike(r"\A[0-9a-f]+\z|\A[0-9A-F]+\z")),
        (n - uncovered) / n,
        (n - without_letters) / n,
        count("[/_-]") / n,
        flag(before.rlike(r"(://|[/\\.])\S*\z") | after.rlike(r"\A\S{0,8}[/\\@]|\A\.[A-Za-z]")),
        flag(before.rlike(SECRET_BEFORE)),
        flag(before.rlike(HARMLESS_BEFORE)),
        flag(before.rlike(ASSIGNED_BEFORE)),
        flag(before.rlike(r"[\"'`]\z") & after.rlike(r"\A[\"'`]")),
        flag(lower.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")),
        count(r"[^A-Za-z0-9_+/=\-]") / n,
        flag(candidate.rlike(r"\A\p{L}+\z")),
        flag(candidate.rlike(ISSUED)),
        (n - F.length(F.regexp_replace(candidate, "[A-Z]?[a-z]{2,}", ""))) / n,
    ]


def _split(df: DataFrame, text: Column) -> DataFrame:
    """Adds the candidates ``_c`` and the gaps ``_g`` around them, one more; null where there is no candidate."""
    hit = F.coalesce(text.rlike(CANDIDATE), F.lit(False))
    runs = F.when(hit, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumns({"_r": runs, "_g": F.when(hit, F.split(text, CANDIDATE, -1))})
    df = df.withColumn("_n", F.transform("_r", lambda r: F.regexp_extract(r, NAMES, 0)))
    rest = F.transform("_r", lambda r, i: F.substring(r, F.length(F.get("_n", i)) + 1, F.length(r)))
    gaps = F.transform("_g", lambda g, i: F.concat(g, F.coalesce(F.get("_n", i), F.lit(""))))  # names go to the gap before
    return df.withColumns({"_c": rest, "_g": gaps}).drop("_r", "_n")


def _beside(i: Column) -> tuple[Column, Column]:
    """What stands before and after the candidate ``i``, through the candidates next to it."""
    part = lambda name, k: F.coalesce(F.get(F.col(name), k), F.lit(""))
    tail = lambda s: F.substring(s, -BEFORE, BEFORE)
    head = lambda s: F.substring(s, 1, AFTER)
    before = F.concat(F.when(i > 0, F.concat(tail(part("_g", i - 1)), tail(part("_c", i - 1)))).otherwise(""), tail(part("_g", i)))
    return tail(before), head(F.concat(head(part("_g", i + 1)), head(part("_c", i + 1))))


def labelled_findings(spark: SparkSession, n: int = 11000) -> DataFrame:
    """before, candidate, after, label: what the scanner finds in ``n`` made-up lines, one kind for each line by its number.

    Secrets: random keys, passwords and UUIDs under a secret's name in four languages, assigned
    (``NAME=value`` in text and urls included), quoted or in a tag, passwords in urls, and
    keys with an issuer's form, or in parts, anywhere.
    Harmless: digests under their names, names of classes and packages, UUIDs, encoded urls, paths, urls and their parameters,
    long words, numbers, identifiers, rulers of one character, and the names
    before secrets.
    """
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    other = F.sha2(F.concat(F.lit("b"), i.cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    word = F.concat(*[F.element_at(F.array(*map(F.lit, DICTIONARY)), F.pmod(F.hash(i, F.lit(k)), F.lit(len(DICTIONARY))) + 1) for k in range(5)])
    parts = "sch ung ment elle cion thre ge lich tion ing eit er be th on ra eau st an en".split()
    syllables = F.substring(F.concat(*[F.element_at(F.array(*map(F.lit, parts)), F.pmod(F.hash(i, F.lit(k)), F.lit(len(parts))) + 1) for k in range(14)]), F.lit(1), F.lit(16) + F.pmod(F.hash(i, F.lit(40)), F.lit(14)))
    snake = F.concat_ws("_", *[F.element_at(F.array(*map(F.lit, DICTIONARY)), F.pmod(F.hash(i, F.lit(k + 9)), F.lit(len(DICTIONARY))) + 1) for k in range(3)])
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.hash(i, F.lit(k)), F.lit(len(values))) + 1)
    name = F.concat(at(["the ", "un ", ". ", "\n", "  ", "der "], 1), at(["token", "secret", "password", "api_key", "API-KEY", "access_key", "auth", "AWS_SECRET_ACCESS_KEY"], 2), at([" = \"", "=", ": ", " = '", "\": \"", "='", " "], 3))
    mild = F.concat(at(["the ", "un ", ". ", "\n", "see ", "und "], 1), at(["sha256", "md5", "commit", "checksum", "revision", "uuid", "hash", "digest"], 2), at([" = \"", "=", ": ", " ", "-"], 3))
    prose = at(["of the ", "in the ", ". ", "\n", "und der ", "le ", ", "], 4)
    close = F.when(F.substring(name, -1, 1).isin("\"", "'"), F.concat(F.substring(name, -1, 1), F.lit(" and"))).otherwise(at([" of", "\n", ", the", "###"], 5))
    url = F.concat(prose, F.lit("https://example.com/"), at(["", "login", "a/b", "api/v1/users"], 11))
    asks, shows = at(["?token=", "?api_key=", "?x=1&access_token=", "?auth=", "?password="], 12), at(["?v=", "?id=", "?x=1&page=", "?ref=", "?etag="], 12)
    tight = F.concat(at(["the ", "un ", ". ", "\n", "--", "export "], 1), at(["token", "secret", "password", "auth_token", "API_KEY", "SECRET_TOKEN", "SECRET_KEY", "db-password"], 2), F.lit("="))
    plain = F.concat(at(["the ", "un ", ". ", "\n", "--", "export "], 1), at(["commit", "build_id", "sha256", "checksum", "etag", "revision", "md5"], 2), F.lit("="))
    # Passwords of 8 to 23 characters, half of them with other characters inside; words, places and calls stand where they could.
    mixed = F.substring(F.regexp_replace(F.base64(F.unhex(other)), "[+/=]", ""), F.lit(1), F.lit(8) + F.pmod(F.hash(i, F.lit(13)), F.lit(16)))
    marked = F.concat(F.substring(mixed, 1, 4), at(list("!@#$%^&*?.,:;~|"), 14), F.substring(mixed, 5, 3), at(list("!@#$%^&*?") + [""], 15), F.substring(mixed, 8, 20))
    spoken = at(["required", "forgotten?", "unbekannt!", "contraseña", "undefined", "optional,", "os.environ[x]", "getpass.getpass()", "request.headers.get", "config.value.name", "${PASSWORD}", "{{secret}}", "********", "xxxxxxxx", "........", "<password>", "process.env.TOKEN", "self.password"], 16)
    lower = F.substring(syllables, F.lit(1), F.lit(8) + F.pmod(F.hash(i, F.lit(17)), F.lit(6)))
    given = F.concat(at(["the ", "un ", ". ", "\n", "db_", "user "], 1), at(["token", "secret", "password", "api_key", "passwd", "pwd", "auth_token", "credential"], 2), at([" = \"", "=", ": ", " = '", "\": \"", "='", " \""], 3))
    shut = F.when(F.substring(given, -1, 1).isin("\"", "'"), F.concat(F.substring(given, -1, 1), at([" and", ",", "\n"], 5))).otherwise(at([" of", "\n", ", the", ". "], 5))
    camel = F.concat(*[F.initcap(F.element_at(F.array(*map(F.lit, DICTIONARY)), F.pmod(F.hash(i, F.lit(k + 20)), F.lit(len(DICTIONARY))) + 1)) for k in range(4)])
    strange = F.concat(*[F.initcap(F.substring(syllables, F.lit(1 + 5 * k), F.lit(3) + F.pmod(F.hash(i, F.lit(k + 30)), F.lit(3)))) for k in range(4)])
    amazon = F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(base64, "[+/]", ""), 1, 16)))
    coded = lambda x: F.substring(F.regexp_replace(F.regexp_replace(F.base64(F.unhex(x)), r"\+", "-"), "/", "_"), 1, 24)
    web = F.concat(F.lit("eyJ"), coded(digest), F.lit(".eyJ"), coded(other), F.lit("."), F.regexp_replace(F.regexp_replace(base64, r"\+", "-"), "/", "_"))
    summed = F.concat(at(["sha512-", "sha256-", "sha384-", ""], 18), base64, at(["==", "=", ""], 19))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    named = F.concat(at(["the ", "", ". ", "\n", "  ", "client_", "our "], 1), at(["token", "secret", "password", "api_key", "api key", "credential"], 2), at([" is ", ": ", "=", " = \"", "\": \"", " ist ", " est "], 3))
    foreign = F.concat(at(["la ", "das ", "le ", ". ", "\n", "mi "], 1), at(["contraseña", "clave", "mot de passe", "mdp", "Kennwort", "Passwort", "clé secrète", "jeton", "Zugangsdaten", "clave secreta"], 2), at([": ", " : ", "=", " = \"", ": '", " \""], 3))
    closed = lambda x: F.when(F.substring(x, -1, 1).isin("\"", "'"), F.substring(x, -1, 1)).otherwise(at(["\n", " ", ", ", ""], 5))
    tag, end = at(["<password>", "<token>", "<secret>", "<pwd>", "<api-key>"], 27), at(["</password>", "</token>", "</secret>", "</pwd>", "</x>"], 27)
    parted = F.concat(at(["SG.", "sq0.", "pat7.", "v1."], 28), F.substring(coded(digest), 1, 22), F.lit("."), F.substring(F.regexp_replace(F.regexp_replace(base64, r"\+", "-"), "/", "_"), 1, 43))
    package = F.concat(at(["org.", "com.", "example.", "self."], 29), F.substring(syllables, 1, 16), F.lit("."), F.concat(camel, F.lit("Context")))
    said = F.base64(F.concat(F.lit("https://example.com/"), snake))
    size = 20 + F.pmod(F.hash(i, F.lit(6)), F.lit(21))
    # What the kinds are made of is written first, so that it isn't planned again with each of them.
    pieces = {
        "digest": digest, "other": other, "base64": base64, "word": word, "snake": snake, "syllables": syllables, "name": name, "mild": mild, "prose": prose, "close": close, "url": url, "asks": asks, "shows": shows, "tight": tight, "plain": plain, "mixed": mixed, "marked": marked, "spoken": spoken, "lower": lower, "given": given, "shut": shut, "camel": camel, "strange": strange, "amazon": amazon, "web": web, "summed": summed, "size": size, "uuid": uuid, "named": named, "foreign": foreign, "tag": tag, "end": end, "parted": parted, "package": package, "said": said,
    }
    made = cut(spark.range(n).select("id", *[x.alias(key) for key, x in pieces.items()]))
    digest, other, base64, word, snake, syllables, name, mild, prose, close, url, asks, shows, tight, plain, mixed, marked, spoken, lower, given, shut, camel, strange, amazon, web, summed, size, uuid, named, foreign, tag, end, parted, package, said = map(F.col, pieces)
    kinds = [
        (name, F.substring(digest, 1, 40), close, 1), (name, F.substring(digest, 1, 32), close, 1), (name, F.substring(base64, 1, 40), close, 1), (name, F.expr("substring(regexp_replace(base64, '[+/=]', ''), 1, 24 + pmod(hash(id), 16))"), close, 1),
        (prose, F.concat(at(["ghp_", "sk-", "xoxb-", "AKIA", "glpat-"], 7), F.substring(F.regexp_replace(base64, "[+/]", ""), 1, 30)), at([" ", "\n", ","], 5), 1), (name, F.substring(digest, 1, 24), close, 1),
        (mild, F.substring(digest, 1, 40), at([" ", "\n", "\""], 5), 0), (mild, digest, at([" ", "\n", "\""], 5), 0), (prose, F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12)), at([" ", "\n", ","], 5), 0),
        (F.concat(prose, F.lit("https://example.com/")), F.concat(snake, F.lit("/"), F.substring(digest, 1, 12)), at(["?x", "/", ".html", " "], 5), 0), (F.concat(prose, F.lit("src/")), snake, F.lit(".py "), 0), (prose, word, at([" ", ".", ","], 5), 0), (prose, syllables, at([" ", ".", ","], 5), 0), (prose, F.initcap(syllables), at([" ", ".", ",", "ä", "é"], 5), 0), (at([".\n", "ä", "é", ". ", "(", "\""], 10), F.initcap(syllables), at([" ", ".", ",", "***"], 5), 0),
        (prose, F.substring(F.regexp_replace(digest, "[a-f]", "7"), 1, 18), at([" ", "\n", "$$$"], 5), 0), (name, snake, close, 0), (name, word, close, 0), (prose, F.repeat(at(["-", "=", "_", "a", "x"], 8), size.cast("int")), F.lit("\n"), 0), (prose, F.concat_ws("-", snake, F.substring(other, 1, 3)), at([" ", "\n"], 5), 0), (prose, F.upper(syllables), at(["!!", " "], 5), 0),
        (F.concat(url, asks), F.substring(digest, 1, 40), at([" ", "\n", "&x=1 "], 5), 1), (F.concat(url, asks), F.substring(base64, 1, 32), at([" ", "\n", "&x=1 "], 5), 1), (F.concat(url, shows), F.substring(digest, 1, 32), at([" ", "\n", "&x=1 "], 5), 0),
        (tight, F.substring(digest, 1, 40), at([" of", "\n", ", the"], 5), 1), (tight, digest, at([" of", "\n", ", the"], 5), 1), (tight, base64, at([" of", "\n", ", the"], 5), 1), (plain, F.substring(digest, 1, 40), at([" of", "\n", ", the"], 5), 0), (plain, digest, at([" of", "\n", ", the"], 5), 0), (tight, snake, at([" of", "\n", ", the"], 5), 0),
        (given, mixed, shut, 1), (given, marked, shut, 1), (given, marked, shut, 1), (F.concat(url, asks), marked, at([" ", "\n", "&x=1 "], 5), 1), (given, spoken, shut, 0), (given, lower, shut, 0), (given, F.substring(word, F.lit(1), F.lit(8) + F.pmod(F.hash(i, F.lit(17)), F.lit(9))), shut, 0),
        (F.concat(prose, at(["class ", "new ", "import ", "see "], 21)), camel, at([" ", "(", ".", ";"], 5), 0), (prose, strange, at([" ", "(", ".", ";"], 5), 0),
        (at(["AWS_ACCESS_KEY_ID=", "aws_access_key_id = ", "key id: ", "the "], 22), amazon, at(["\n", " ", ","], 5), 1), (at(["Authorization: Bearer ", "jwt ", "auth=", "cookie: "], 23), web, at(["\n", " ", "\""], 5), 1),
        (F.concat(prose, at(["postgres://admin:", "https://user:", "amqp://x:", "mysql://root:"], 24)), F.regexp_replace(marked, "[:@/]", "-"), at(["@db.example.com/x", "@localhost:5432/app", "@host "], 5), 1), (F.concat(prose, at(["postgres://admin:", "https://user:", "amqp://x:"], 24)), mixed, at(["@db.example.com/x", "@localhost:5432/app"], 5), 1),
        (F.concat(prose, at(["https://", "git://"], 25)), F.concat(at(["ghp_", "glpat-", "gho_"], 7), F.substring(F.regexp_replace(base64, "[+/]", ""), 1, 30)), at(["@example.com/a", ":x@host"], 5), 1),
        (F.concat(at(["\"integrity", "checksum", "sha384", "\"digest", "md5"], 26), at(["\": \"", ": ", "=", " "], 3)), summed, at(["\"", " ", "\n"], 5), 0),
        (named, uuid, closed(named), 1), (foreign, marked, closed(foreign), 1), (foreign, F.substring(digest, 1, 32), closed(foreign), 1), (foreign, lower, closed(foreign), 0), (tag, marked, end, 1), (tag, F.substring(digest, 1, 32), end, 1), (tag, lower, end, 0), (tag, spoken, end, 0),
        (F.concat(prose, at(["key ", "", "send with ", "use "], 21)), parted, at([" ", "\n", ","], 5), 1), (F.concat(prose, at(["class ", "import ", "see ", ""], 21)), package, at([" ", "(", ".", ";"], 5), 0), (F.concat(prose, at(["issue ", "see ", "data ", "id "], 21)), said, at([" ", "\n", ","], 5), 0),
    ]
    pick = F.pmod(i, F.lit(len(kinds)))
    row = None  # a line evaluates its own kind only
    for k, (before, candidate, after, label) in enumerate(kinds):
        own = F.struct(before.alias("before"), candidate.alias("candidate"), after.alias("after"), F.lit(float(label)).alias("label"))
        row = F.when(pick == k, own) if row is None else row.when(pick == k, own)
    made = cut(made.select(row.alias("r")))  # several jobs read it
    lines = _split(made.withColumn("line", F.concat("r.before", "r.candidate", "r.after")), F.col("line"))
    start, end = F.length("r.before"), F.length("r.before") + F.length("r.candidate")

    def labelled(c: Column, i: Column) -> Column:
        before, after = _beside(i)
        at = F.aggregate(F.slice("_c", 1, i), F.lit(0), lambda t, x: t + F.length(x)) + F.aggregate(F.slice("_g", 1, i + 1), F.lit(0), lambda t, x: t + F.length(x))
        own = (at < end) & (at + F.length(c) > start)  # the line's key, not its name or its neighbours
        return F.struct(before.alias("before"), c.alias("candidate"), after.alias("after"), F.when(own, F.col("r.label")).otherwise(0.0).alias("label"))

    return lines.select(F.explode(F.transform("_c", labelled)).alias("f")).select("f.*")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from before, candidate, after, label; the caller bounds the number of findings."""
    values = findings.select(F.array(*features(F.col("candidate"), F.col("before"), F.col("after"))).alias("f"), "label")
    columns = cut(values).select(*[F.col("f")[k].alias(name) for k, name in enumerate(FEATURES)], "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(columns)
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)


def forest(model: RandomForestClassificationModel, values: Column) -> Column:
    """The share of the model's trees that vote for 1, as an expression over an array of features."""

    def tree(lines: list[tuple[int, str]], at: int) -> tuple[Column, int]:
        depth, text = lines[at]
        if m := re.match(r"Predict: ([\d.]+)", text):
            return F.lit(float(m[1])), at + 1
        k, op, bound = re.match(r"If \(feature (\d+) (<=|>) ([-\d.E]+)\)", text).groups()
        yes, at = tree(lines, at + 1)
        no, at = tree(lines, at + 1)  # the line of Else
        x = F.get(values, F.lit(int(k)))
        return F.when(x <= float(bound) if op == "<=" else x > float(bound), yes).otherwise(no), at

    votes = []
    for t in model.trees:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in t.toDebugString.splitlines()[1:] if x.strip()]
        votes.append(tree(lines, 0)[0])
    return reduce(lambda a, b: a + b, votes) / F.lit(float(len(votes)))


def secret_scan(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs``, with n_candidates, secrets and redacted.

    ``secrets`` is an array of (start, length, text, score), start counted from 0
    in characters, in the order of the text; ``redacted`` is the text with each
    replaced by ``<SECRET>``. A null text stays null and, as an empty one, has no
    candidates. Whole texts are read; repeated rows each get theirs; columns of
    ``docs`` named like results are replaced.
    """
    docs = docs.drop("n_candidates", "secrets", "redacted")
    text = F.col(text_col).cast("string")
    df = _split(docs, text)
    gap = lambda i: F.get(F.col("_g"), i)

    def described(c: Column, i: Column) -> Column:
        before, after = _beside(i)
        return F.array(*features(c, before, after))

    df = df.withColumn("_f", F.transform("_c", described))
    df = df.withColumn("_s", F.transform("_f", lambda f: forest(model, f)))
    # Where candidates start: sums of lengths in parts of about the square root of their number, and of the parts before.
    last = F.size("_c") - 1
    df = df.withColumns({"_l": F.transform("_c", lambda c, i: F.length(gap(i)) + F.length(c)), "_b": F.ceil(F.sqrt(F.greatest(F.size("_c"), F.lit(1)))).cast("int")})
    total = lambda x: F.aggregate(x, F.lit(0), lambda t, y: t + y)
    parts = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.floor(last / F.col("_b")).cast("int")), lambda j: total(F.slice("_l", j * F.col("_b") + 1, F.col("_b")))))
    df = df.withColumn("_t", parts).withColumn("_p", F.transform("_t", lambda t, j: total(F.slice("_t", F.lit(1), j))))

    def secret(i: Column) -> Column:
        part = F.floor(i / F.col("_b")).cast("int")
        start = F.get("_p", part) + total(F.slice("_l", part * F.col("_b") + 1, i - part * F.col("_b"))) + F.length(gap(i))
        c = F.get("_c", i)
        return F.struct(start.cast("int").alias("start"), F.length(c).cast("int").alias("length"), c.alias("text"), F.get("_s", i).alias("score"))

    found = F.when(last >= 0, F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: F.get("_s", i) >= threshold), secret))
    hidden = F.transform("_c", lambda c, i: F.concat(gap(i), F.when(F.get("_s", i) >= threshold, F.lit(REDACTED)).otherwise(c)))
    return df.select(
        *docs.columns,
        F.coalesce(F.when(F.col("_c").isNotNull(), F.size("_c")), F.lit(0)).alias("n_candidates"),
        F.coalesce(found, F.expr("cast(array() as array<struct<start:int,length:int,text:string,score:double>>)")).alias("secrets"),
        F.when(F.col("_c").isNull(), text).otherwise(F.concat(F.array_join(hidden, ""), F.element_at("_g", -1))).alias("redacted"),
    )
