"""Prompt assembly: flat few-shot prompts, chat messages and their rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The instructions and worked examples that models are prompted with. The examples
# quote abusive posts, since the task is to rewrite such posts for training a classifier.
SYSTEM_ENGLISH = (
    "You are a text enhancement tool. Generate a paraphrased version of the input tweet in the same "
    "language, limiting its length to around 50 characters and reinforcing the emotions it contains, "
    "while retaining its meaning and the type of cyberbullying. Don't think, just give the sentence."
)
SYSTEM_CHINESE = (
    "你是一个文本增强工具。将输入的中文网络攻击性内容中使用的谐音梗、反讽、表情符号等替代性表达，"
    "全部转换为对应的正常文字表达。在保留原意、攻击类型的前提下，强化原有情绪，使其更直接、更有冲击力。"
    "不要分析，不要解释，直接输出改写后的句子。"
)
EXAMPLES = (
    ("@risqiaditya f*** hate you", "I fucking hate you so much"),
    ("I fucking love you!", "I love you very much"),
    ("i fucking hate school so much", "I don't want to go to school"),
    ("辣鸡快递", "垃圾快递，太废物了这个快递"),
    ("NMSL", "你妈死了"),
)
CHINESE_CODES = ("cn", "zh")

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def _turn(role: str, content: str) -> str:
    # Fixed format of one turn in a flat prompt
    return f"<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>\n"


def flat_prompt_frame(
    system: str = SYSTEM_ENGLISH, examples: Sequence[tuple[str, str]] = EXAMPLES
) -> tuple[str, str]:
    """The constant text in front of and behind the input of a flat few-shot prompt."""
    shots = "".join(
        _turn("user", f"Input: {given}") + _turn("assistant", f"Augmented: {wanted}")
        for given, wanted in examples
    )
    before = "<|begin_of_text|>" + _turn("system", system) + shots
    # the input's own turn, cut where the input goes; the reply is left open for the model
    opening, closing = _turn("user", "Input: \0").split("\0")
    return before + opening, closing + "<|start_header_id|>assistant<|end_header_id|>\n\nAugmented: "


def flat_prompt(
    text: Column, system: str = SYSTEM_ENGLISH, examples: Sequence[tuple[str, str]] = EXAMPLES
) -> Column:
    before, after = flat_prompt_frame(system, examples)
    return F.concat(F.lit(before), text, F.lit(after))


def system_text(lang: Column | str) -> Column:
    """Chinese instruction for Chinese input, English otherwise; decided per row."""
    code = F.lit(lang) if isinstance(lang, str) else lang
    return F.when(code.isin(*CHINESE_CODES), F.lit(SYSTEM_CHINESE)).otherwise(F.lit(SYSTEM_ENGLISH))


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def chat_messages(
    text: Column, lang: Column | str = "en", examples: Sequence[tuple[str, str]] = EXAMPLES
) -> Column:
    """System text, worked examples as user/assistant pairs, then the input, as an array of messages."""
    shots = [
        message(role, F.lit(content))
        for pair in examples
        for role, content in zip(("user", "assistant"), pair)
    ]
    return F.array(message("system", system_text(lang)), *shots, message("user", text)).cast(MESSAGES_TYPE)


def single_message(prompt: Column) -> Column:
    return F.array(message("user", prompt)).cast(MESSAGES_TYPE)


def append_reply(messages: Column, reply: Column) -> Column:
    return F.array_append(messages, message("assistant", reply))


def render_message(role: Column, content: Column) -> Column:
    return F.concat(role, F.lit("\n"), content)


def render_chat(messages: Column, open_reply: bool = False) -> Column:
    """Default chat layout: role, line break, content per message, nothing between messages."""
    body = F.array_join(F.transform(messages, lambda m: render_message(m["role"], m["content"])), "")
    return F.concat(body, F.lit("assistant\n")) if open_reply else body
