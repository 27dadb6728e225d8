"""White space as Python's ``str.strip`` and ``\\s`` count it."""

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as the inside of a Java character class.
WITHIN_LINE = r"\t\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANY = r"\n" + WITHIN_LINE
