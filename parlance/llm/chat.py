"""Chat formatting: records of many layouts become one template, with a loss mask.

A record is a JSON text.  Its fingerprint is the hash of its nested field paths (names and lists,
without the types of the leaves, whatever the order of the fields), and the fingerprint selects a
declared ``Layout``: where the turns are, and which roles they have.  All of it is Spark SQL
expressions (variant functions, higher-order functions); no Python runs on the rows.

The template marks every turn by its role and escapes the marks inside texts: a backslash is put
after every backslash and after the first character of every mark, so that no mark is left in a text
and the text can be had back (``unescape``).  A formatted part holds one record's turns; its mask is the list of
(start, length) of the assistants' texts in code points.

Defined results: a record that is null, no JSON or of no declared layout has a null layout and null
turns, and stays as a row without formatted text; a null text or role counts as empty; a role that
the template does not know is written with its name; a content that is no string is its JSON
text; an empty list of turns is an empty text.  Repeated rows stay.  Columns besides key, order and payload are ignored.
A record may be as large as a variant (128 MB); a digest needs the text of its conversation as one value (2 GB).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

TURNS = 16  # turns of a record that the query makes of rows
LONG = 1 << 18  # bytes of a text that gets a record of its own there


def shape_of(paths: tuple[str, ...]) -> str:
    """Paths such as ``messages[].role`` as one nested text, names in order."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})

    def write(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{write(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {inner}" if (inner := write(node[k])) else k for k in sorted(node)) + ">" if node else ""

    return write(tree)


def shape(record: Column) -> Column:
    """The nested field paths of a variant, in the writing of ``shape_of``."""
    leaf = r"[A-Z_]+(?:\([0-9, ]*\))?"
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), f": {leaf}(?=[,>])", ""), f"(?<=ARRAY<){leaf}(?=>)", "")


def fingerprint(record: Column) -> Column:
    return F.sha2(shape(record), 256)


@dataclass(frozen=True)
class Layout:
    """A declared mapping: either ``fields`` ((role, path), ...) or a list ``turns`` with names of its ``role`` and ``text``."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: str = ""  # where a text is a list of parts, the name of the text in a part
    roles: dict[str, str] = field(default_factory=dict, hash=False)  # other names of roles
    optional: tuple[str, ...] = ()  # paths that a record may have besides

    def fingerprints(self) -> list[str]:
        if self.fields:
            sets = [tuple(p for _, p in self.fields)]
        else:
            sets = [(f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}" + (f"[].{self.parts}" if self.parts else "")), (f"{self.turns}[]",)]
        more = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [hashlib.sha256(shape_of(s + c).encode()).hexdigest() for s in sets for c in more]

    def expression(self, record: Column) -> Column:
        """The canonical turns of a record of this layout: array of (role, text)."""
        turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        if self.fields:
            return F.array(*[turn(F.lit(r), F.try_variant_get(record, f"$.{p}", "string")) for r, p in self.fields])
        kind = f"array<struct<`{self.parts}`:string>>" if self.parts else "string"
        rows = F.try_variant_get(record, f"$.{self.turns}", f"array<struct<`{self.role}`:string,`{self.text}`:{kind}>>")
        known = [x for pair in self.roles.items() for x in map(F.lit, pair)]
        role = (lambda m: F.coalesce(F.create_map(*known)[m[self.role]], m[self.role])) if known else (lambda m: m[self.role])
        text = (lambda m: F.array_join(F.transform(m[self.text], lambda p: p[self.parts]), "")) if self.parts else (lambda m: m[self.text])
        return F.transform(rows, lambda m: turn(role(m), text(m)))


# fixed values: names that public data sets of these layouts use
LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content", optional=("id",)),
    Layout("message parts", turns="messages", role="role", text="content", parts="text", optional=("messages[].content[].type",)),
    Layout("conversations", turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}, optional=("id",)),
    Layout("prompt and response", fields=(("user", "prompt"), ("assistant", "response")), optional=("id",)),
    Layout("system, prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("id",)),
    Layout("instruction and output", fields=(("user", "instruction"), ("assistant", "output")), optional=("id",)),
    Layout("instruction, input and output", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("id",)),
    Layout("question and answer", fields=(("user", "question"), ("assistant", "answer")), optional=("id",)),
)


def canonical(records: DataFrame, payload: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with (layout, turns array<struct<role, text>>) in place of the JSON column ``payload``."""
    rows = records.withColumn("_v", F.try_parse_json(F.col(payload).cast("string"))).withColumn("_f", fingerprint(F.col("_v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for one in reversed(layouts):
        hit = F.col("_f").isin(one.fingerprints())
        name, turns = F.when(hit, F.lit(one.name)).otherwise(name), F.when(hit, one.expression(F.col("_v"))).otherwise(turns)
    rest = [c for c in records.columns if c not in (payload, "layout", "turns")]
    return rows.select(*rest, name.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """Marks of the roles' texts (opening, closing), and of texts with the name of another role (opening, between, closing)."""

    system: tuple[str, str] = ("<<SYS>>", "<</SYS>>")
    user: tuple[str, str] = ("[INST]", "[/INST]")
    assistant: tuple[str, str] = ("<s>", "</s>")
    other: tuple[str, str, str] = ("<<ROLE>>", "<:>", "<</ROLE>>")

    @property
    def roles(self) -> dict[str, tuple[str, str]]:
        return {"system": self.system, "user": self.user, "assistant": self.assistant}

    @property
    def marks(self) -> tuple[str, ...]:
        return (*self.system, *self.user, *self.assistant, *self.other)

    def escape(self, text: Column) -> Column:
        ends: dict[str, list[str]] = {}
        for m in self.marks:
            ends.setdefault(m[0], []).append(re.escape(m[1:]))
        starts = "".join(f"|{re.escape(c)}(?={'|'.join(rest)})" for c, rest in ends.items())
        return F.regexp_replace(text, r"\\" + starts, r"$0\\")

    def unescape(self, text: Column) -> Column:
        firsts = "".join(re.escape(c) for c in sorted({m[0] for m in self.marks}))
        return F.regexp_replace(text, rf"([\\{firsts}])\\", "$1")

    def head(self, turn: Column) -> Column:
        """What is written before a turn's text."""
        named = F.concat(F.lit(f"{self.other[0]} "), self.escape(turn["role"]), F.lit(f" {self.other[1]} "))
        for role, (mark, _) in self.roles.items():
            named = F.when(turn["role"] == role, F.lit(f"{mark} ")).otherwise(named)
        return named

    def tail(self, turn: Column) -> Column:
        end = F.lit(f" {self.other[2]}\n")
        for role, (_, mark) in self.roles.items():
            end = F.when(turn["role"] == role, F.lit(f" {mark}\n")).otherwise(end)
        return end

    def parse(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted text."""
        closers = [c for _, c in self.roles.values()] + [self.other[2]]
        pieces = F.filter(F.split(formatted, "(?<=" + "|".join(re.escape(f" {c}\n") for c in closers) + ")"), lambda p: p != "")

        def turn(p: Column) -> Column:
            between = f" {self.other[1]} "
            cut = lambda s, before, after: s.substr(F.lit(before + 1), F.char_length(s) - (before + after))
            inner = cut(p, len(self.other[0]) + 1, len(self.other[2]) + 2)
            role = F.substring_index(inner, between, 1)
            text = inner.substr(F.char_length(role) + len(between) + 1, F.char_length(inner))
            role = self.unescape(role)
            for name, (a, b) in self.roles.items():
                here = p.startswith(f"{a} ")
                role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, cut(p, len(a) + 1, len(b) + 2)).otherwise(text)
            return F.struct(role.alias("role"), self.unescape(text).alias("text"))

        return F.transform(pieces, turn)


def formatted(records: DataFrame, template: Template) -> DataFrame:
    """``canonical`` records with (formatted, loss array<struct<start, length>>) in place of the turns."""
    written = F.transform("turns", lambda t: F.struct(template.head(t).alias("head"), template.escape(t["text"]).alias("text"), template.tail(t).alias("tail"), (t["role"] == "assistant").alias("loss")))
    rows = records.withColumn("_w", written)
    sizes = F.transform("_w", lambda w: (F.char_length(w["head"]) + F.char_length(w["text"]) + F.char_length(w["tail"])).cast("long"))
    rows = rows.withColumn("_n", sizes)
    start = lambda i: F.aggregate(F.slice("_n", F.lit(1), i), F.lit(0).cast("long"), lambda a, n: a + n)
    spans = F.transform("_w", lambda w, i: F.struct((start(i) + F.char_length(w["head"])).alias("start"), F.char_length(w["text"]).cast("long").alias("length"), w["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    text = F.array_join(F.transform("_w", lambda w: F.concat(w["head"], w["text"], w["tail"])), "")
    return rows.select(*[c for c in records.columns if c not in ("turns", "formatted", "loss")], text.alias("formatted"), loss.alias("loss"))


def read_back(parts: DataFrame, template: Template) -> DataFrame:
    """``parts`` with what their text holds: (turns, loss_text), the text under the mask without escapes."""
    under = F.transform("loss", lambda s: template.unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return parts.withColumns({"turns": template.parse(F.col("formatted")), "loss_text": F.array_join(under, "")})


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, block, piece, payload): rows (conv_id, turn, role, text) as records of several layouts, in order of (block, piece).

    A record holds up to ``TURNS`` rows in order of (turn, role, text); near a text of over
    ``LONG`` bytes it holds one.  A user's and an assistant's row become a pair of fields,
    with a system row before them three; other rows a list of messages.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    block = Window.partitionBy("conv_id", "block")
    rows = rows.withColumn("block", F.floor(F.col("turn") / TURNS))
    rows = rows.withColumns({"place": F.row_number().over(block.orderBy("turn", "role", "text")), "longest": F.max(F.octet_length("text")).over(block)})
    rows = rows.withColumn("piece", F.when(F.col("longest") > LONG, F.col("place")).otherwise(F.floor((F.col("place") - 1) / TURNS)).cast("long"))
    made = rows.groupBy("conv_id", "block", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("m"))
    roles, text = F.transform("m", lambda t: t["role"]), lambda k: F.col("m")[k]["text"]
    even = F.coalesce(F.col("conv_id") % 2, F.lit(0)) == 0
    names = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "system")))
    lists = F.when(even | ~F.forall(roles, lambda r: r.isin("user", "assistant", "system")), F.to_json(F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))).otherwise(
        F.to_json(F.struct(F.transform("m", lambda t: F.struct(names[t["role"]].alias("from"), t["text"].alias("value"))).alias("conversations")))
    )
    pair, three = roles == F.array(*map(F.lit, ("user", "assistant"))), roles == F.array(*map(F.lit, ("system", "user", "assistant")))
    fields = lambda *names: F.to_json(F.struct(*[text(k).alias(n) for k, n in enumerate(names)]))
    payload = (
        F.when(pair & even, fields("prompt", "response")).when(pair, fields("instruction", "output"))
        .when(three & even, fields("system", "prompt", "response")).when(three, fields("instruction", "input", "output")).otherwise(lists)
    )
    return made.select("conv_id", "block", "piece", payload.alias("payload"))


def chat_files(records: DataFrame, key: str, order: list[str], payload: str, folder: str, template: Template = Template(), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Writes the formatted parts (key, order, layout, formatted, loss) as Parquet and returns them as read."""
    formatted(canonical(records.select(key, *order, payload), payload, layouts), template).write.parquet(folder)
    return records.sparkSession.read.parquet(folder)


def digests(parts: DataFrame, key: str, order: list[str], template: Template = Template()) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from what the parts hold."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(parts, template).select(
        key, *order, F.size("turns").cast("long").alias("n"), said.alias("said"), "loss_text", F.char_length("formatted").cast("long").alias("chars")
    )
    whole = lambda c: F.sha2(F.array_join(F.transform("all", lambda p: p[c]), ""), 256)
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "said", "loss_text"))).alias("all"), F.sum("n").alias("n_turns"), F.sum(F.char_length("loss_text").cast("long")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    return rows.select(key, "n_turns", whole("said").alias("turns_sha256"), "loss_chars", whole("loss_text").alias("loss_sha256"), "formatted_chars")


SAMPLE = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    parts = chat_files(records_of(rows.unionByName(sample)), "conv_id", ["block", "piece"], "payload", f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}")
    return digests(parts, "conv_id", ["block", "piece"])


_ORACLE = """
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marks AS (
    SELECT unnest(['\\', '<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '<<ROLE>>', '<:>', '<</ROLE>>']) AS mark
), added AS (
    SELECT t.text, sum((length(t.text) - length(replace(t.text, mark, ''))) // length(mark)) AS n
    FROM (SELECT text FROM c UNION SELECT role FROM c) t, marks GROUP BY t.text
), f AS (
    SELECT c.*, length(c.text) + a.n + CASE c.role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 27 + length(c.role) + r.n END AS chars
    FROM c JOIN added a ON a.text = c.text JOIN added r ON r.text = c.role
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

QUERIES = {"op13_chat": op13_chat}
ORACLES = {"op13_chat": _ORACLE}
