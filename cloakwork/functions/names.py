"""How a variable's name is read: segments, terms that mark secrets or settings, and whether the value agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shape import listed, parts_of, stripped

# Words that say a value is a credential.
SECRET_TERMS = """
    SECRET PASSWORD PASSWD PWD PASS PASSPHRASE TOKEN PRIVATE CREDENTIAL CRED CREDS KEY APIKEY SALT SIGNING SIGNATURE DSN
    CERT CERTIFICATE AUTH BEARER JWT MNEMONIC PHRASE SEED HMAC TOTP PIN NONCE PAT SAS WEBHOOK ENCRYPTION CIPHER
    API_KEY ACCESS_KEY SECRET_KEY PRIVATE_KEY SIGNING_KEY AUTH_KEY LICENSE_KEY CLIENT_SECRET WEBHOOK_URL KEY_ID
    SEED_PHRASE RECOVERY_PHRASE SERVICE_ROLE CONNECTION_STRING ENCRYPTION_IV
""".split()
# Words that say a value is a setting, by the kind of value they call for.
CONFIG_TERMS = {
    "number": "TTL TIMEOUT DURATION INTERVAL DELAY RETRY RETRIES LIMIT MAX MIN COUNT SIZE PORT ROUNDS ATTEMPTS THRESHOLD DAYS HOURS MINUTES SECONDS MS WORKERS CONCURRENCY REPLICAS LENGTH DEPTH OFFSET PAGE BACKOFF QUOTA WEIGHT PRIORITY EXPIRY EXPIRES EXPIRATION PER_PAGE",
    "path": "PATH FILE DIR DIRECTORY FOLDER ROOT HOME SOCKET MOUNT",
    "version": "VERSION RELEASE TAG",
    "bool": "ENABLED DISABLED ENABLE DISABLE DEBUG VERBOSE STRICT DRY INSECURE",
    "word": "LEVEL MODE ENV ENVIRONMENT LOCALE TIMEZONE TZ CURRENCY LANG LANGUAGE FORMAT REGION ZONE STAGE TIER PROFILE DRIVER ADAPTER ENGINE PROVIDER STRATEGY SCHEME PROTOCOL METHOD CHANNEL TOPIC QUEUE BUCKET NAMESPACE CLUSTER COLOR THEME PLATFORM ARCH",
    "url": "URL URI ENDPOINT HOST HOSTNAME DOMAIN ORIGIN ADDR ADDRESS SERVER",
    "any": "PUBLIC PUBLIC_KEY",
    "label": "ALGORITHM ALGO ISSUER AUDIENCE TYPE PREFIX SUFFIX HEADER HEADER_NAME",
}
# Settings that any secret word in the name overrules.
WEAK_TERMS = {
    "any": "NAME ID LABEL TITLE DESCRIPTION SLUG IDENTIFIER USER USERNAME EMAIL",
    "hash": "SHA SHA1 SHA256 SHA512 MD5 HASH COMMIT REVISION REV DIGEST CHECKSUM ETAG FINGERPRINT INTEGRITY SRI",
}
# Words that a public prefix never opens, and the prefixes.
NEVER_PUBLIC = """
    SECRET PASSWORD PASSWD PWD PASS PASSPHRASE PRIVATE CREDENTIAL CRED CREDS TOKEN SIGNING SALT MNEMONIC PHRASE SEED HMAC
    TOTP PIN PAT SAS ENCRYPTION CIPHER SERVICE_ROLE CONNECTION_STRING PRIVATE_KEY SECRET_KEY CLIENT_SECRET
""".split()
PUBLIC_PREFIX = r"\A(NEXT_PUBLIC_|EXPO_PUBLIC_|VITE_|REACT_APP_|PUBLIC_|NUXT_PUBLIC_|GATSBY_)"


def segments(key: Column) -> Column:
    """Upper-case words of a name."""
    return F.transform(parts_of(key, "[_\\-./: \\t]"), F.upper)


def singular(word: Column) -> Column:
    """Without a final S, if that leaves a secret word."""
    cut = F.regexp_replace(word, r"S\z", "")
    return F.when((F.length(word) > 3) & word.endswith("S") & F.array_contains(listed([t for t in SECRET_TERMS if "_" not in t]), cut), cut).otherwise(word)


def terms(key: Column) -> Column:
    """Candidate terms from the right: at each word the pair with the word before it, then the word itself."""
    s = segments(key)
    back = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))))
    at = lambda i: F.when(i >= 1, F.get(s, i - 1))
    return F.filter(F.flatten(F.transform(back, lambda i: F.array(F.when(i > 1, F.concat_ws("_", F.get(s, i - 2), at(i))), singular(at(i))))), lambda t: t.isNotNull())


def host_label(value: Column) -> Column:
    """What stands before the first colon of a value."""
    return F.split_part(stripped(value), F.lit(":"), F.lit(1))


def agrees(kind: str, value: Column, random: Column, label_random: Column) -> Column:
    """Whether a value is of the kind that a setting's name calls for; an empty one always is.

    `random` and `label_random`: whether the value and its `host_label` look random, computed once by the caller."""
    v = stripped(value)
    name = r"[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"

    def word() -> Column:
        return (F.octet_length(v) <= 24) & ~v.rlike("[ \\t\\n\\r]") & ~random

    def host() -> Column:
        base = host_label(value)
        dotted = v.rlike(rf"\A{name}(\.{name})+(:[0-9]{{1,5}})?(/[^\n]*)?\z")
        return F.contains(v, F.lit("://")) | dotted | (base.rlike(r"\A[a-z0-9][a-z0-9-]{0,62}\z") & base.rlike("[a-z]{3}") & ~label_random)

    def path() -> Column:
        parts = F.split(v, "/")
        return ~F.contains(v, F.lit("://")) & (F.octet_length(v) <= 512) & (F.size(parts) >= 2) & ~F.exists(parts, lambda p: F.octet_length(p) > 64) & v.rlike("[a-z]{3}")

    by = {
        "any": lambda: F.lit(True),
        "number": lambda: v.rlike(r"\A-?[0-9]+(\.[0-9]+)?[\t\n\f\r ]*[A-Za-z%]{0,3}\z"),
        "bool": lambda: F.lower(v).isin("true", "false", "yes", "no", "on", "off", "1", "0", "enabled", "disabled"),
        "version": lambda: v.rlike(r"\A[vV]?[0-9]+(\.[0-9]+){0,3}([-+][0-9A-Za-z.-]+)?\z"),
        "hash": lambda: v.rlike(r"\A[0-9a-fA-F]{7,64}\z"),
        "path": path,
        "url": host,
        "word": word,
        "label": lambda: word() | host(),
    }
    return (v == "") | by[kind]()


KINDS = sorted({*CONFIG_TERMS, *WEAK_TERMS})
