"""The cleaning rules once more, stated as plain patterns for Python's ``re``."""

import re

# Prefixes and patterns of the cleaning rules, in their order.
PRODUCT = "Acme"
PREFIXES = (
    "### Operating system", "### Acme version", "### Desktop version info", "### Current behaviour",
    "### Expected behaviour", "### Logs", "_No response_", "Operating system", "Acme version",
    "Desktop version info", "Current behaviour", "Expected behaviour", "Logs",
)


def keep_lines(keep):
    return lambda text: "\n".join(line for line in text.split("\n") if keep(line.strip()))


def substitute(pattern, by=""):
    return lambda text: re.sub(pattern, by, text)


# Step name, rule; in their fixed order.
RULES = {
    "drop_boilerplate": keep_lines(
        lambda line: not any(re.match(re.escape(p), line, re.IGNORECASE) for p in PREFIXES)
    ),
    "drop_images": substitute(r"!\[.*?\]\(.*?\)"),
    "drop_code_fences": substitute(r"```[\s\S]*?```"),
    "drop_inline_code": substitute(r"`[^`\n]*`"),
    "unwrap_links": substitute(r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    "unwrap_bold": substitute(r"\*\*(.*?)\*\*", r"\1"),
    "unwrap_italic": substitute(r"\*(.*?)\*", r"\1"),
    "unwrap_underline": substitute(r"__(.*?)__", r"\1"),
    "unwrap_underscore": substitute(r"_(.*?)_", r"\1"),
    "drop_quotes": keep_lines(lambda line: not line.startswith(">")),
    "drop_mail_footers": substitute(r"(?m)^On .+, .+ wrote:.*$"),
    "drop_signatures": substitute(r"(?m)--+\s*$"),
    "squeeze_newlines": substitute(r"\n{3,}", "\n\n"),
    "squeeze_spaces": substitute(r" {2,}", " "),
    "strip": str.strip,
}


def clean(text: str) -> str:
    for rule in RULES.values():
        text = rule(text)
    return text


def strip_fence(text: str) -> str:
    text = re.sub(r"(?m)^```json\s*", "", text)
    return re.sub(r"(?m)\s*```$", "", text).strip()
