"""Every pattern, word list and limit below is one that results depend on.

Patterns are written so that Java and RE2 read them alike: SPACE stands for Unicode white
space, \\z for the strict end of a text.
"""

SPACE = r"[\t-\r\x{85}\p{Z}]"

EMAIL = r"([A-Za-z0-9](?:[A-Za-z0-9._%+\-/=]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
MAILBOX = r"([A-Za-z0-9._%+\-/=]+@[A-Za-z0-9.\-]+)"

# Entities and look-alike characters, in the order in which they are replaced.
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
    ("\u00a0", " "),
    ("\u200b", " "),
    ("\u2018", "'"),
    ("\u2019", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
    ("\u2039", "<"),
    ("\u276e", "<"),
    ("\u3008", "<"),
    ("\uff1c", "<"),
    ("\u203a", ">"),
    ("\u276f", ">"),
    ("\u3009", ">"),
    ("\uff1e", ">"),
    ("\u3010", "["),
    ("\u3011", "]"),
)
MARKUP = r"</?(?:u|s|change)>"

# Quoted-printable remains in lower-cased text.
QUOTED = (("=40", "@"), ("=2e", "."), ("=5f", "_"), ("=2d", "-"))
QUOTED_BLANKS = ("=20", "=09", "=0a", "=0d")

WEBMAIL = ("gmail", "googlemail", "yahoo", "hotmail", "outlook", "icloud", "me", "mac", "msn", "live", "gmx", "aol", "protonmail", "ymail", "rocketmail")
ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "int", "co", "io", "ai", "me", "tv", "us", "uk", "ru", "fr", "de", "ch", "it", "nl", "se", "no", "es", "br", "ca", "mx")

BEFORE_LOCAL = r"""(^|[<"'\[(])([a-z0-9._%+\-/=]+)(?:§|#)"""
HASH_WEBMAIL = BEFORE_LOCAL + "(" + "|".join(WEBMAIL) + r")\."
HASH_DOMAIN = BEFORE_LOCAL + r"([a-z0-9-]+\.(?:" + "|".join(ENDINGS) + r"))\b"

MISREAD_HOSTS = ("@grnail.", "@gmall.", "@smail.", "@tmail.")
MISREAD_COM = (r"\.(?:corn|cord)[a-z]?\z", r"\.con\z")

SUSPICIOUS = r"§|#|=|grnail|gmall|smail|tmail|corn|cord|\.con\b"
WEBMAIL_DOMAIN = "(" + "|".join(w + r"\.com" for w in WEBMAIL) + ")"

# Characters that may stand next to a whole address.
LEFT_OF_ADDRESS = "<\"'([ \t"
RIGHT_OF_ADDRESS = ">\"')] \t,;"

# Audit patterns.
MASK = "redacted|█"
TAG = "<(/?u|/?s|change)>"
EDGE_SPACE = f"^{SPACE}|{SPACE}\\z"
STRAY_SPACE = f"^{SPACE}|{SPACE}\\z|  +|\\x{{a0}}"
BLANK = f"^{SPACE}*\\z"
EMPTY_LIST = f"^{SPACE}*\\[{SPACE}*\\]{SPACE}*\\z"
EMPTY_STRING_LIST = f'\\[{SPACE}*""{SPACE}*\\]'
PLACEHOLDERS = f"^{SPACE}*(\\[\\]{SPACE}*)+\\z"
EMPTY_TOKEN = r"\[\]"

# Limits of an address, in characters.
MAX_ADDRESS, MAX_LOCAL, MAX_DOMAIN = 320, 64, 255

RECIPIENT_ROLES = ("to_recipients", "cc_recipients", "bcc_recipients")
