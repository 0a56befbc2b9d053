"""Secrets in text: candidates by pattern, false positives removed by a random forest.

Everything runs in the JVM: regular expressions find candidates, array expressions
make their features inside the row, and the trained trees are themselves an
expression. Nothing is shuffled to find or to remove secrets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import fresh, quoted, stored

# Fixed values of this operator: what counts as a candidate, and the words its features know.
# A name is taken from its start and tried first, so that it never counts as a value or as part of one.
NAME = (
    r"(?<![A-Za-z0-9_.+/-])[A-Za-z0-9_.+/-]*(?i:key|token|secret|passw(?:or)?d|pwd|credential)s?"
    r"(?:[_.-][A-Za-z0-9_.-]{0,40}|[0-9]{1,3})?"
)
SIGN = NAME + r"""["'`\])]{0,2}\s{0,16}(?::=|=>|==|[:=])"""
SCHEME = r"(?:(?i:bearer|basic|token)\s)?"
OPENED = SIGN + r"""\s{0,16}["']""" + SCHEME
UNQUOTED = SIGN + r"[ \t]{0,16}" + SCHEME
# Addresses and key blocks have forms of their own.
ELSEWHERE = r"(?!-----BEGIN|(?:[A-Za-z][A-Za-z0-9+.-]{0,20}:)?//)"
# Repetitions are possessive: Java would otherwise take a stack frame for each.
ASSIGNED = "|".join(
    [
        OPENED + ELSEWHERE + r"""(?:(?<=")(?=[^"\r\n]{6})(?:[^"\\\r\n]++|\\.)++(?=")|(?<=')(?=[^'\r\n]{6})(?:[^'\\\r\n]++|\\.)++(?=')|[^"'\s]{6,})""",
        # Up to the next blank, without closing marks, a quote that ends something or the next tag.
        UNQUOTED + ELSEWHERE + r"""(?=[^\s"'`]\S{5})"""
        r"""(?:[^\s"'`<>,;)}\]]++|[,;)}\]]++(?=[^\s"'`<>,;)}\]])|["'`](?=\w)|[<>](?!/?[A-Za-z][A-Za-z0-9]*[\s/>]|[\s"'<>]|$))++""",
    ]
)
LOGIN = r""":(?<=://[^\s:/@"'<>]{0,255}:)[^\s/"'<>]+(?=@)"""
BLOCK = (
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,})++)"
)
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{LOGIN}|{BARE}"
PREFIX = f"^(?:{OPENED}|{UNQUOTED}|:)(?=[^=])"
DICTIONARY = (
    "access account admin api app auth aws backup base beta build cache card change changeme client cloud code config "
    "copy data database date default demo dev docker document dummy email empty enter env example fake file final foo "
    "from github group guest head header hello here home host image insert item key local login main manager master "
    "message mock model module my name network node none null number object order page pass password path placeholder "
    "please private prod product project public query region release remote replace report request response root "
    "sample secret section server service session staging stage start state string super system table tech temp "
    "template test text this time todo token type unit update upload user value version video web with word xxxx your"
).split()
SECRET_WORDS = r"(?i)(key|token|secret|passw|pwd|credential|bearer|authorization|auth)\W{0,6}\w{0,12}\W{0,6}$"
OTHER_WORDS = (
    r"(?i)\b(commit|rev|sha\d*|md5|crc|hash|checksum|digest|etag|uuid|guid|id|no|nr|isbn|card|phone|tel|fax|iban|order|"
    r"invoice|tracking|version|build|ref|base64|image|src|href|class|color|example|sample)\W{0,6}$"
)
EXAMPLE_PATHS = r"(?i)(^|[/_.-])(tests?|docs?|examples?|samples?|fixtures?|mocks?|demo)([/_.-]|$)"
EXPRESSION = r"^[$%@&]?[{(<\[]|^\$\w+$|^[A-Za-z_]\w*([.:>-]+[A-Za-z_]\w*)*[(\[]|^[A-Za-z_]+([.:]+[A-Za-z_]+)+;?$"
REDACTED = "[SECRET]"

CONTEXT_CHARS = 48
OFFSET_BLOCK = 512


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 20
    depth: int = 6
    seed: int = 31
    threshold: float = 0.5  # share of trees that call a candidate a secret


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


#: Features of a candidate by name: (value, text before, text after, path) -> number.
FEATURES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "length": lambda v, b, a, p: F.length(v).cast("double"),
    "digits": lambda v, b, a, p: _share(v, "[0-9]"),
    "upper": lambda v, b, a, p: _share(v, "[A-Z]"),
    "lower": lambda v, b, a, p: _share(v, "[a-z]"),
    "symbols": lambda v, b, a, p: _share(v, "[^A-Za-z0-9]"),
    "letter_digit_transitions": lambda v, b, a, p: _share(v, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
    "case_transitions": lambda v, b, a, p: _share(v, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
    "repeats": lambda v, b, a, p: _share(v, r"(.)(?=\1)"),
    "distinct": lambda v, b, a, p: F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
    "vowel_pairs": lambda v, b, a, p: _share(v, "(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])"),
    "dictionary": lambda v, b, a, p: F.lit(1.0)
    - F.length(F.regexp_replace(v, "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.length(v),
    "hexadecimal": lambda v, b, a, p: _flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
    "number": lambda v, b, a, p: _flag(v.rlike("^[0-9+-]+$")),
    "grouped": lambda v, b, a, p: _flag(v.rlike("^[0-9A-Za-z]+(-[0-9A-Za-z]+){2,}$")),
    "secret_word_before": lambda v, b, a, p: _flag(b.rlike(SECRET_WORDS)),
    "assigned": lambda v, b, a, p: _flag(b.rlike(r"""[:=]\s*["']?$""")),
    "other_word_before": lambda v, b, a, p: _flag(b.rlike(OTHER_WORDS)),
    "address_before": lambda v, b, a, p: _flag(b.rlike(r"(://|@|www\.)\S*$")),
    "quoted_after": lambda v, b, a, p: _flag(a.rlike("^[\"'`]")),
    "login": lambda v, b, a, p: _flag(b.endswith(":") & a.startswith("@")),
    "block": lambda v, b, a, p: _flag(v.startswith("-----BEGIN")),
    "blanks": lambda v, b, a, p: _share(v, r"\s"),
    "expression": lambda v, b, a, p: _flag(v.rlike(EXPRESSION)),
    "example_path": lambda v, b, a, p: _flag(p.rlike(EXAMPLE_PATHS)),
}


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    return F.array(*[F.coalesce(f(value, before, after, path), F.lit(0.0)) for f in FEATURES.values()])


# --- training -------------------------------------------------------------

# Labelled findings (fixed values): a context, how its value is drawn, and whether it is a secret.
SECRET_CONTEXTS = [
    'the token = "', 'TOKEN = "', 'api_key: "', "secret='", 'password = "', 'client_secret = "', 'access-token: "',
    "export API_TOKEN=", "aws_secret_access_key = ", "Authorization: Bearer ", 'db_password: "', 'private_key = "',
    'auth_token="', "x-api-key: ", 'set pwd = "', 'and the key = "',
]
SECRET_VALUES = ["hex32", "hex40", "hex64", "HEX40", "base64", "mixed40", "mixed20", "prefixed", "AKIA"]
PASSWORD_CONTEXTS = [
    "password: ", "DB_PASSWORD=", "secret = ", "  client_secret: ", "PWD=", 'password = "', "export API_SECRET=", "token=",
]
PASSWORD_VALUES = ["password8", "password11", "marked11", "letters26", "mixed20"]
LOGIN_CONTEXTS = ["postgres://bob:", "url: https://admin:", "mysql+driver://db_user:", 'amqp://app:']
LOGIN_VALUES = [*PASSWORD_VALUES, "hex32"]
BLOCK_CONTEXTS = ["", 'private_key: "', "key:\n", "it was the\n"]
OTHER_CONTEXTS = [
    "commit ", "the md5 ", "sha256 checksum: ", 'etag: "', "uuid=", "order no. ", "card ", "tel. ", "invoice ", "id ",
    "https://host.example.com/page/", "mail to user@host.example.com/", "isbn ", "it was the ", "of the and ", ". ",
    "rev ", 'src="data:image/png;base64,', "der die das ", "la de los ", "tracking ", 'class="',
]
OTHER_VALUES = ["hex32", "hex40", "hex64", "digits16", "digits20", "uuid", "words", "base64"]
PLACEHOLDER_VALUES = ["words", "placeholder", "repeated"]
NO_PASSWORD_VALUES = ["words", "placeholder", "repeated", "word", "syllables", "sentence", "call", "member", "variable"]
EXAMPLES_EACH = 6


def _drawn(kind: Column, number: Column) -> dict[str, Column]:
    """A value of every kind, made from the digest of a kind and a number."""
    digest = F.sha2(F.concat(kind, number.cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "Q")
    # One literal, not one for each word.
    known = F.split(F.lit(" ".join(DICTIONARY)), " ")
    word = lambda i: F.element_at(
        known, (F.pmod(F.xxhash64(number, F.lit(i)), F.lit(len(DICTIONARY))) + 1).cast("int")
    )
    letters = F.translate(mixed, "0123456789", "GhKmPrTvXz")
    pairs = F.split(F.lit(" ".join(c + v for c, v in zip("bdfklmnprstvghwc", "aeiouaeioaeiouae", strict=True))), " ")
    syllables = lambda n: F.array_join(
        F.transform(F.split(F.substring(digest, 20, n), ""), lambda c: F.element_at(pairs, (F.conv(c, 16, 10) + 1).cast("int"))), ""
    )
    body = F.concat_ws("\n", *[F.base64(F.unhex(F.sha2(F.concat(digest, F.lit(str(i))), 256))) for i in range(3)])
    block = lambda name: F.concat(F.lit(f"-----BEGIN {name}-----\n"), body, F.lit(f"\n-----END {name}-----"))
    return {
        "hex32": F.substring(digest, 1, 32),
        "hex40": F.substring(digest, 1, 40),
        "hex64": digest,
        "HEX40": F.upper(F.substring(digest, 1, 40)),
        "base64": F.base64(F.unhex(digest)),
        "mixed40": F.substring(mixed, 1, 40),
        "mixed20": F.substring(mixed, 1, 20),
        "prefixed": F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
        "AKIA": F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(digest, 1, 16)), "0189", "GHJK")),
        "digits16": F.lpad(F.pmod(F.xxhash64(digest), F.lit(10**16)).cast("string"), 16, "4"),
        "digits20": F.lpad(F.pmod(F.xxhash64(digest), F.lit(10**18)).cast("string"), 20, "0"),
        "uuid": F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "words": F.concat(F.concat_ws("-", word(1), word(2), word(3)), F.lit("-v2")),
        "placeholder": F.concat(F.upper(word(1)), F.lit("_"), word(2), F.lit("_example_key_123")),
        "password8": F.concat(syllables(3), F.substring(F.conv(F.substring(digest, 1, 8), 16, 10), 1, 1), F.substring(letters, 1, 1)),
        "password11": F.concat(F.initcap(syllables(2)), F.substring(mixed, 1, 4), F.substring(F.conv(F.substring(digest, 1, 8), 16, 10), 1, 3)),
        "marked11": F.concat(F.substring(mixed, 1, 4), F.element_at(F.split(F.lit("!&#$%*"), ""), (F.pmod(number, F.lit(6)) + 1).cast("int")), F.initcap(syllables(3)), F.lit("3")),
        "letters26": F.substring(letters, 1, 26),
        "word": F.concat(word(1), word(2)),
        "syllables": syllables(4),
        "sentence": F.concat_ws(" ", word(1), syllables(2), word(2), syllables(3), word(3)),
        "call": F.concat(word(1), F.lit("_"), syllables(2), F.lit("("), word(2), F.lit(")")),
        "member": F.concat(word(1), F.lit("."), syllables(3)),
        "variable": F.concat(F.lit("${"), F.upper(word(1)), F.lit("_"), F.upper(word(2)), F.lit("}")),
        "private": block("PRIVATE KEY"),
        "private rsa": block("RSA PRIVATE KEY"),
        "repeated": F.concat(F.repeat(F.substring(digest, 1, 1), 24), F.lit("0000")),
    }


def labelled_findings(spark: SparkSession) -> DataFrame:
    """The findings the forest learns from by default: before, value, after, path, label.

    Every context meets every value of its kind, in plain and in example paths; a
    placeholder is no secret even where one is assigned.
    """
    pairs = [(c, v, 1.0) for c in SECRET_CONTEXTS for v in SECRET_VALUES]
    pairs += [(c, v, 0.0) for c in OTHER_CONTEXTS for v in OTHER_VALUES]
    pairs += [(c, v, 0.0) for c in SECRET_CONTEXTS for v in PLACEHOLDER_VALUES]
    pairs += [(c, v, 1.0) for c in PASSWORD_CONTEXTS for v in PASSWORD_VALUES]
    pairs += [(c, v, 0.0) for c in PASSWORD_CONTEXTS for v in NO_PASSWORD_VALUES]
    pairs += [(c, v, 1.0) for c in LOGIN_CONTEXTS for v in LOGIN_VALUES]
    pairs += [(c, v, 1.0) for c in BLOCK_CONTEXTS for v in ("private", "private rsa")]
    rows = spark.createDataFrame(
        [(i, c, v, label) for i, (c, v, label) in enumerate(pairs)], "pair int, before string, kind string, label double"
    )
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(EXAMPLES_EACH))))
    number = F.col("pair") * EXAMPLES_EACH + F.col("turn")
    drawn = _drawn(F.col("kind"), number)
    value = F.coalesce(*[F.when(F.col("kind") == k, drawn[k]) for k in sorted({v for _, v, _ in pairs})])
    path = F.element_at(F.array(*map(F.lit, ["src/main", "", "tests/data", "web"])), F.pmod("turn", F.lit(4)).cast("int") + 1)
    after = F.when(F.col("before").rlike("\"$"), '" ').when(F.col("before").rlike("'$"), "' ").when(F.col("before").rlike("://[^/]*:$"), "@db.host ").otherwise(" ")
    return rows.select("before", value.alias("value"), after.alias("after"), path.alias("path"), "label")


Tree = float | tuple[int, float, "Tree", "Tree"]


@dataclass(frozen=True)
class Forest:
    """Trees as (feature, threshold, if at most, else) or the label of a leaf."""

    trees: list[Tree]
    settings: ForestSettings

    def score(self, found: Column) -> Column:
        """The share of trees that call a candidate with these features a secret.

        The trees are one SQL text: a column for each node would cost the driver several
        calls into the JVM, thousands for a forest.
        """

        def expression(tree: Tree) -> str:
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            feature, threshold, low, high = tree
            return f"CASE WHEN f[{feature}] <= {threshold!r}D THEN {expression(low)} ELSE {expression(high)} END"

        votes = " + ".join(map(expression, self.trees))
        return F.element_at(F.call_function("transform", F.array(found), F.expr(f"f -> ({votes}) / {len(self.trees)}")), 1)


def train(labelled: DataFrame, settings: ForestSettings = ForestSettings()) -> Forest:
    """Fit a forest on labelled findings (before, value, after, path, label; nulls count as empty).

    A finding is scanned as the text it comes from, and what the scanner cuts from the
    labelled value is learned with its label; a value without a candidate teaches nothing.
    The findings are few against the documents; their texts and features are written
    once, as every level of the trees reads them again.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("value", "before", "after", "path")}
    rows = labelled.where("label is not null and length(value) > 0").select(
        "label", *[c.alias(n) for n, c in text.items()]
    )
    begin = F.length("before")
    placed = rows.select("label", "path", F.concat("before", "value", "after").alias("text"), begin.alias("begin"), (begin + F.length("value")).alias("end"))
    placed = stored(placed, "labelled_texts")
    cut = F.filter("cut", lambda c: (c["start"] < F.col("end")) & (c["stop"] > F.col("begin")))
    found = _each(with_candidates(placed, "cut", path="path"), cut, "label").select("label", F.col("item.features").alias("f"))
    names = list(FEATURES)
    flat = found.select("label", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])
    # Sorted, so that bootstrap samples do not depend on how the findings arrived.
    flat = stored(flat.coalesce(1).sort("label", *names), "labelled_findings")
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(flat).coalesce(1)
    model = RandomForestClassifier(
        numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, featuresCol="features", labelCol="label"
    ).fit(vectors)
    return Forest(list(_read_trees(model.toDebugString)), settings)


def _read_trees(described: str) -> Iterator[Tree]:
    """The trees of a model's description: nested If and Else lines and Predict lines."""
    lines = iter([line.strip() for line in described.splitlines()])

    def read() -> Tree:
        line = next(lines)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = read()
        next(lines)  # Else, the same feature and threshold
        return int(feature), float(threshold), low, read()

    for line in lines:
        if line.startswith("Tree "):
            yield read()


# --- scanning -------------------------------------------------------------


def _running(lengths: Column, start: Column) -> Column:
    """For each element the sum of ``start`` and all elements before it."""
    empty = F.struct(start.cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(
        lengths,
        empty,
        lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")),
    )["before"]


def _offsets(lengths: Column) -> Column:
    """Running sums, in blocks: the work stays near linear for a text with very many candidates."""
    n_blocks = F.ceil(F.size(lengths) / OFFSET_BLOCK).cast("int")
    numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda k: F.slice(lengths, k * OFFSET_BLOCK + 1, OFFSET_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, n: s + n))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), _running(sums, F.lit(0)).alias("s")), lambda z: _running(z["b"], z["s"])))


def with_candidates(docs: DataFrame, name: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with an array column ``name``: start, stop, value, features of each candidate.

    ``start`` and ``stop`` count characters (code points) of the whole text. Null and
    empty texts have an empty array. A null path counts as empty.
    """
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    gaps, hits = fresh(docs, "_gaps", "_hits")
    has = whole.rlike(CANDIDATE)
    made = docs.withColumns(
        {
            hits: F.when(has, F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")),
            gaps: F.when(has, F.split(whole, CANDIDATE, -1)).otherwise(F.array().cast("array<string>")),
        }
    )
    n = F.size(hits)
    lengths = F.zip_with(F.slice(F.col(gaps), 1, n), F.col(hits), lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))
    where = F.lit("") if path is None else F.coalesce(F.col(quoted(path)).cast("string"), F.lit(""))
    # Everything an element needs travels with it: a reference from inside a lambda to
    # another array would be worked out anew for each element.
    parts = F.arrays_zip(
        F.col(hits).alias("hit"),
        F.slice(F.col(gaps), 1, n).alias("gap"),
        F.slice(F.col(gaps), 2, n).alias("next"),
        _offsets(lengths).alias("begin"),
    )

    def finding(part: Column) -> Column:
        hit, gap = part["hit"], part["gap"]
        named = F.regexp_extract(hit, PREFIX, 0)
        prefix = F.length(named)
        value = F.substring(hit, prefix + 1, F.length(hit))
        before = F.concat(F.right(gap, F.lit(CONTEXT_CHARS)), named)
        after = F.left(part["next"], F.lit(CONTEXT_CHARS))
        start = part["begin"] + F.length(gap) + prefix
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("stop"),
            value.alias("value"),
            features(value, before, after, where).alias("features"),
        )

    return made.withColumn(name, F.transform(parts, finding))


def with_findings(docs: DataFrame, forest: Forest, name: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with an array column ``name``: start, stop, value, score, is_secret of each candidate.

    Places and empty texts are as in ``with_candidates``.
    """
    (bare,) = fresh(docs, "_candidates")
    made = with_candidates(docs, bare, text, path)
    scored = F.transform(bare, lambda c: F.struct(c["start"], c["stop"], c["value"], forest.score(c["features"]).alias("score")))
    verdict = F.transform(
        scored,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["stop"].alias("stop"),
            c["value"].alias("value"),
            c["score"].alias("score"),
            (c["score"] >= forest.settings.threshold).alias("is_secret"),
        ),
    )
    return made.withColumn(name, verdict)


def scan(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, stop, value, score, is_secret.

    Texts without a candidate have no row; an empty table has none. Repeated rows repeat
    their findings. Other columns are ignored.
    """
    columns = [F.col(quoted(id_column)).alias("doc_id"), F.col(quoted(text)).alias("text")]
    columns += [] if path is None else [F.col(quoted(path)).alias("path")]
    found = with_findings(docs.select(*columns), forest, "findings", path=None if path is None else "path")
    return _each(found, F.col("findings"), "doc_id").select("doc_id", "item.*")


def _each(rows: DataFrame, items: Column, *columns: str) -> DataFrame:
    """One row per element of ``items``, as column ``item``, next to ``columns``.

    A plain explode makes the optimizer filter on the array's size below the projections,
    with every expression the array is made of written out in that filter. Exploding empty
    arrays too, and dropping their rows, keeps the patterns evaluated once.
    """
    return rows.select(*columns, F.explode_outer(items).alias("item")).where("item is not null")


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = None, n_chars: str | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; other text and columns stay.

    ``n_chars`` names a column that holds the length of the text, to be kept true. A
    null text stays null.
    """
    (findings,) = fresh(docs, "_findings")
    found = with_findings(docs, forest, findings, text, path)
    whole, secrets = F.col(quoted(text)), F.filter(F.col(findings), lambda c: c["is_secret"])
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(secrets, lambda c: c["stop"]))
    starts = F.concat(F.transform(secrets, lambda c: c["start"]), F.array(F.length(whole).cast("bigint")))
    kept = F.zip_with(ends, starts, lambda stop, start: F.substring(whole, (stop + 1).cast("int"), (start - stop).cast("int")))
    clean = F.when(F.size(secrets) > 0, F.array_join(kept, REDACTED)).otherwise(whole)
    changed = {text: clean}
    if n_chars is not None:
        cut = F.aggregate(secrets, F.lit(0).cast("bigint"), lambda n, c: n + c["stop"] - c["start"] - len(REDACTED))
        changed[n_chars] = F.when(F.size(secrets) > 0, F.length(whole) - cut).otherwise(F.col(quoted(n_chars)))
    types = dict(docs.dtypes)
    return found.select(*[changed[c].cast(types[c]).alias(c) if c in changed else F.col(quoted(c)) for c in docs.columns])
