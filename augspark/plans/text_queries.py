"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from augspark.functions import prompts, templates, text as tx
from augspark.functions.subwords import Subwords
from augspark.operators import chats
from augspark.plans.fixtures import FX_LABELED, first_sentence_sql, fx_labeled, strip_sql, table
from augspark.plans.registry import query


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


CLEAN_COMMAS_SQL = """case when contains(line, ',')
  then replace(left(line, length(line) - length(split_part(line, ',', -1)) - 1), ',', '，') || ',' || split_part(line, ',', -1)
  else line end"""


@query(f"""
with lines as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
                      unnest(string_split(text, chr(10))) as raw from documents),
     cut as (select doc_id, line_no, regexp_replace(raw, '[\\r\\n]+\\z', '') as line from lines)
select doc_id, line_no::bigint as line_no, {CLEAN_COMMAS_SQL} as cleaned from cut""")
def clean_commas(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.clean_commas(F.col("line")).alias("cleaned"))


@query("select doc_id, substring(text, 1, 500) as truncated, length(substring(text, 1, 500))::bigint as n from documents")
def truncate_input(spark, sf):
    cut = tx.truncate_chars(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cut.alias("truncated"), F.length(cut).cast("bigint").alias("n"))


_BEFORE, _AFTER = prompts.flat_prompt_frame()


@query(f"select doc_id, concat({quoted(_BEFORE)}, text, {quoted(_AFTER)}) as prompt from documents")
def flat_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", prompts.flat_prompt(F.col("text")).alias("prompt"))


@query(f"""
with outputs as (
  select doc_id, case length(text) % 3 when 0 then text || '<|eot_id|>'
    when 1 then concat('Augmented: x<|eot_id|>Augmented: ', text, ' <|eot_id|> Augmented')
    else concat(text, 'Augmented:  ', text, ' ') end as output from documents),
cut as (select doc_id, output, split_part(output, 'Augmented: ', -1) as last from outputs)
select doc_id, {strip_sql("case when contains(output, 'Augmented: ') then split_part(last, '<|eot_id|>', 1) else output end")} as completion
from cut""")
def extract_completion(spark, sf):
    text = F.col("text")
    rest = F.length(text) % 3
    output = (
        F.when(rest == 0, F.concat(text, F.lit("<|eot_id|>")))
        .when(rest == 1, F.concat(F.lit("Augmented: x<|eot_id|>Augmented: "), text, F.lit(" <|eot_id|> Augmented")))
        .otherwise(F.concat(text, F.lit("Augmented:  "), text, F.lit(" ")))
    )
    return table(spark, sf, "documents").select("doc_id", tx.extract_completion(output).alias("completion"))


@query(f"""
with outputs as (select doc_id, concat(' ', text, ' <|im_end|>') as output from documents)
select doc_id, {first_sentence_sql("output")} as sentence from outputs""")
def first_sentence(spark, sf):
    output = F.concat(F.lit(" "), F.col("text"), F.lit(" <|im_end|>"))
    return table(spark, sf, "documents").select("doc_id", tx.first_sentence(output).alias("sentence"))


@query("""
select d.doc_id, d.text || ' ' || b.text as joined from documents d left join benchmark b on d.doc_id = b.item_id
where d.text is not null and b.text is not null""")
def join_rewrite(spark, sf):
    rewrites = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("rewrite"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(rewrites, "doc_id", "left")
    return docs.select("doc_id", tx.join_rewrite(F.col("text"), F.col("rewrite")).alias("joined")).dropna("any")


@query("""
select doc_id, case when quality = 1 then toxic else null end as label, quality = 0 as rejected from labels""")
def int_labels(spark, sf):
    raw = F.when(F.col("quality") == 1, F.col("toxic").cast("string")).otherwise("not a number")
    label = tx.int_label(raw, strict=False)
    return table(spark, sf, "labels").select("doc_id", label.alias("label"), label.isNull().alias("rejected"))


@query("""
select doc_id, toxic as class_id, case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 end as lang_id
from documents join labels using (doc_id)""")
def class_index(spark, sf):
    name = F.when(F.col("label") == 1, "cyberbullying").otherwise("not_cyberbullying")
    return fx_labeled(spark, sf).select(
        "doc_id",
        tx.class_index(name, ["not_cyberbullying", "cyberbullying"]).alias("class_id"),
        tx.class_index(F.col("lang"), ["en", "fr", "de"], strict=False).alias("lang_id"),
    )


@query("select doc_id, replace(concat('USERNAME: ', text, ' @USERNAME'), 'USERNAME', '某人') as masked from documents")
def replace_user_mask(spark, sf):
    text = F.concat(F.lit("USERNAME: "), F.col("text"), F.lit(" @USERNAME"))
    return table(spark, sf, "documents").select("doc_id", tx.replace_user_mask(text).alias("masked"))


@query(f"""
with words as (select doc_id, string_split_regex({strip_sql("text")}, '[ \\t\\n\\x0B\\f\\r]+') as w from documents)
select doc_id, array_to_string(w[1:128], ' ') as head, array_to_string(w[greatest(len(w) - 128, 0) + 1:len(w)], ' ') as tail from words""")
def truncate_tokens(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.truncate_tokens(text, 128, "first").alias("head"),
        tx.truncate_tokens(text, 128, "last").alias("tail"),
    )


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query()
def truncate_subwords(spark, sf):
    """First and last 128 sub-word tokens of every text, and how many it has."""
    tokenizer, text = Subwords(spark, vocabulary_path()), F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        tokenizer.count(text).alias("n_tokens"),
        tokenizer.truncate(text, 128, "first").alias("head"),
        tokenizer.truncate(text, 128, "last").alias("tail"),
    )


@query(f"""
select doc_id, case when code in ('cn', 'zh') then {quoted(prompts.SYSTEM_CHINESE)} else {quoted(prompts.SYSTEM_ENGLISH)} end as system_text
from (select doc_id, case lang when 'fr' then 'cn' when 'de' then 'zh' else lang end as code from documents)""")
def system_text_by_language(spark, sf):
    code = F.when(F.col("lang") == "fr", "cn").when(F.col("lang") == "de", "zh").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", prompts.system_text(code).alias("system_text"))


# -- prompts ------------------------------------------------------------------------------------


@query(f"""
select doc_id, 12::bigint as n_messages, 'system' as first_role, {quoted(prompts.SYSTEM_ENGLISH)} as first_content,
  'user,assistant,user,assistant,user,assistant,user,assistant,user,assistant' as example_roles,
  {quoted("|".join(content for pair in prompts.EXAMPLES for content in pair))} as example_contents,
  'user' as last_role, text as last_content from documents""")
def chat_messages(spark, sf):
    messages = F.col("messages")
    examples = F.slice(messages, 2, F.size(messages) - 2)
    roles = F.transform(examples, lambda m: m["role"])
    contents = F.transform(examples, lambda m: m["content"])
    return (
        table(spark, sf, "documents")
        .select("doc_id", prompts.chat_messages(F.col("text"), F.col("lang")).alias("messages"))
        .select(
            "doc_id",
            F.size(messages).cast("bigint").alias("n_messages"),
            messages[0]["role"].alias("first_role"),
            messages[0]["content"].alias("first_content"),
            F.array_join(roles, ",").alias("example_roles"),
            F.array_join(contents, "|").alias("example_contents"),
            F.element_at(messages, -1)["role"].alias("last_role"),
            F.element_at(messages, -1)["content"].alias("last_content"),
        )
    )


@query("""
select conv_id, string_agg(role || chr(10) || text, '' order by turn, role, text) as rendered from conversations group by 1""")
def render_conversations(spark, sf):
    return chats.render_conversations(table(spark, sf, "conversations")).select("conv_id", "rendered")


@query("select conv_id, turn, role || chr(10) || text as rendered from conversations")
def render_turns(spark, sf):
    return chats.render_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "rendered")


@query("""
select conv_id, string_agg(role || chr(10) || text, '' order by turn, role, text) || 'assistant' || chr(10) || 'reply to ' || conv_id
    || 'assistant' || chr(10) as rendered
from conversations group by conv_id""")
def append_reply(spark, sf):
    reply = F.concat(F.lit("reply to "), F.col("conv_id").cast("string"))
    return chats.with_reply(table(spark, sf, "conversations"), reply).select("conv_id", "rendered")


@query("select item_id, 1::bigint as n_messages, 'user' as role, text as content from benchmark")
def single_message(spark, sf):
    messages = F.col("messages")
    return (
        table(spark, sf, "benchmark")
        .select("item_id", prompts.single_message(F.col("text")).alias("messages"))
        .select(
            "item_id",
            F.size(messages).cast("bigint").alias("n_messages"),
            messages[0]["role"].alias("role"),
            messages[0]["content"].alias("content"),
        )
    )


TEMPLATES = (
    'A {"placeholder": "text_a"} comment : {"mask"}',
    ' {"placeholder": "text_a"}  The subject here is {"mask"} .',
    '{"soft": "<soft>"} {"placeholder": "text_a"} {"special": "<sep>"} {"mask"} .',
    ' {"soft":"clicked news :"} {"placeholder": "text_a"} {"mask"} {"soft":None,"duplicate":3} {"placeholder": "text_b"}',
)


@query("""
select doc_id,
  concat('A ', text, ' comment : [MASK]') as rendered_0,
  concat(' ', text, ' The subject here is [MASK] .') as rendered_1,
  concat('<soft> ', text, ' <sep> [MASK] .') as rendered_2,
  concat(' clicked news : ', text, ' [MASK] <soft><soft><soft> ', lang) as rendered_3
from documents""")
def render_template(spark, sf):
    columns = {"text_a": F.col("text"), "text_b": F.col("lang")}
    rendered = [templates.render_template(t, columns).alias(f"rendered_{i}") for i, t in enumerate(TEMPLATES)]
    return table(spark, sf, "documents").select("doc_id", *rendered)


WORKED_EXAMPLES = "Q: Is water wet?\nAnswer Choices:\n(a) yes|(b) no\nA: Water is wet. So the answer is (a)."


@query(f"""
select doc_id, concat({quoted(WORKED_EXAMPLES)}, chr(10), chr(10), 'Q: ', text, chr(10), 'Answer Choices:', chr(10),
  '(a) ', lang, '|(b) ', source, chr(10), 'A: [MASK]') as prompt from documents""")
def worked_example_prompt(spark, sf):
    choices = F.array(
        F.struct(F.lit("a").alias("label"), F.col("lang").alias("text")),
        F.struct(F.lit("b").alias("label"), F.col("source").alias("text")),
    )
    prompt = templates.worked_example_prompt(WORKED_EXAMPLES, F.col("text"), choices)
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))
