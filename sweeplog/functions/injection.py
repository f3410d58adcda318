"""Scan for log text that addresses an AI system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.functions.lines import python_strip

# Signal name, pattern (case-insensitive), reason.
SIGNALS = (
    ("instruction_override", r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?)",
     "text attempts to override earlier instructions"),
    ("role_marker", r"(^|\W)(system|assistant|user)\s*:\s*(you|please|act|respond)",
     "text imitates a chat role marker"),
    ("prompt_reference", r"(system\s+prompt|your\s+instructions|developer\s+message)",
     "text refers to the model's own prompt"),
    ("model_address", r"\b(you\s+are\s+an?\s+(ai|assistant|language\s+model)|dear\s+(ai|assistant))\b",
     "text addresses an AI system directly"),
    ("output_steering", r"(mark\s+(this|it)\s+as|classify\s+(this|it)\s+as|report\s+(this|it)\s+as)\s+\w+",
     "text tries to steer a classification or report field"),
    ("control_tokens", r"(<\|[a-z_]+\|>|\[/?INST\]|<<SYS>>)",
     "text contains chat-template control tokens"),
    ("tool_call_shape", r"\"?(tool_calls?|function_call)\"?\s*[:=]\s*[\[{]",
     "text is shaped like a tool call"),
)
CONTEXT_CHARS = 40
EXCERPT_CHARS = 240
FLAGS = "(?iU)"


def _excerpt(text: Column, pattern: str) -> Column:
    """Match with its context. The prefix is measured in code points, as `substring` counts."""
    before = F.length(F.regexp_extract(text, f"(?isU)^(.*?)(?:{pattern})", 1))
    match = F.length(F.regexp_extract(text, FLAGS + pattern, 0))
    start = F.greatest(F.lit(0), before - CONTEXT_CHARS)
    window = F.substring(text, start + 1, before + match + CONTEXT_CHARS - start)
    return F.substring(python_strip(window), 1, EXCERPT_CHARS)


# Words without which a pattern cannot match: any of the groups, all words of a group. Lower case.
REQUIRED = {
    "instruction_override": (("ignore",),),
    "role_marker": (("system", ":"), ("assistant", ":"), ("user", ":")),
    "prompt_reference": (("system", "prompt"), ("your", "instructions"), ("developer", "message")),
    "model_address": (("you", "are"), ("dear",)),
    "output_steering": (("mark",), ("classify",), ("report",)),
    "control_tokens": (("<|",), ("inst]",), ("<<sys>>",)),
    "tool_call_shape": (("tool_call",), ("function_call",)),
}
# Letters outside ASCII that match an ASCII letter when case is ignored; lower() does not fold them.
FOLDED = ("\u017f", "\u212a", "\u0130", "\u0131")


def candidate(text: Column) -> Column:
    """Substring test that is true for every line some pattern could match, and false for most others."""

    def any_group(lowered: Column) -> Column:
        test = F.lit(False)
        for groups in REQUIRED.values():
            for words in groups:
                every = F.lit(True)
                for word in words:
                    every = every & F.contains(lowered, F.lit(word))
                test = test | every
        return test

    test = F.exists(F.array(F.lower(text)), any_group)
    for letter in FOLDED:
        test = test | F.contains(text, F.lit(letter))
    return test


def signals(text: Column) -> Column:
    """One struct per pattern that occurs in the text, in the order of SIGNALS."""
    found = [
        F.when(
            text.rlike(FLAGS + pattern),
            F.struct(F.lit(name).alias("signal"), F.lit(why).alias("why"), _excerpt(text, pattern).alias("excerpt")),
        )
        for name, pattern, why in SIGNALS
    ]
    return F.array_compact(F.array(*found))


def scan(lines: DataFrame, text: str = "text") -> DataFrame:
    """Signals of every line, one row per line and pattern. Narrow: no shuffle, works on streams."""
    others = [c for c in lines.columns if c != text]
    hits = lines.filter(candidate(F.col(text))).select(*others, F.explode(signals(F.col(text))).alias("_s"))
    return hits.select(*others, "_s.signal", "_s.why", "_s.excerpt")
