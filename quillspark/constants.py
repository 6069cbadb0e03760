"""Fixed values that must equal the original tool's for identical results.

Everything in the block below is data, not logic: class names, prompt
templates, the brand list, the site patterns, the default entity label set
and the reasoning-model ids. They are stated verbatim and in natural order.
"""

# --- fixed values (must match the original tool verbatim) -------------------

CLASS_0 = "factual"
CLASS_1 = "satiră"

SYSTEM_PROMPT_CHAT = (
    "Ești un expert in detecția satirei și a ironiei în propoziții. "
    "O să primești o propoziție și trebuie să o adnotezi cu `{class0}` sau `{class1}`.\n"
    "\n"
    "Răspunsul final îl vei oferi în următorul format:\n"
    "\n"
    "```\n"
    "RĂSPUNS: <RĂSPUNS>\n"
    "```\n"
    "\n"
    "unde <RĂSPUNS> este `{class0}` sau `{class1}`.\n"
    "\n"
    'Nu oferi explicații sau să zici altceva decât "RĂSPUNS: <RĂSPUNS>". '
    "Te rog să respecți formatul cerut, altfel răspunsul va fi considerat greșit."
)

SYSTEM_PROMPT_SIMPLE = (
    "Ești un expert in detecția satirei și a ironiei în propoziții. "
    "O să primești o propoziție și trebuie să o adnotezi cu `{class0}` sau `{class1}`."
)

USER_PROMPT_CHAT = "PROPOZIȚIE: {sentence}"

USER_PROMPT_COMPLETION = "PROPOZIȚIE: {sentence}\nRĂSPUNS: "

ASSISTANT_PROMPT = "RĂSPUNS: {answer}"

# Answer marker searched (upper-cased) in free-text chat answers.
ANSWER_MARKER = "RĂSPUNS:"

# Entity labels masked by default.
DEFAULT_ENTITY_LABELS = ("PERSON", "NORP", "GPE", "ORG", "LOC", "FAC")

# Brand names replaced by <ORG>, case-sensitive substrings, in this order.
BRANDS = (
    "TNR",
    "Google",
    "BitDefender",
    "Bitdefender",
    "Facebook",
    "RDS",
    "Samsung",
    "Apple",
    "Youtube",
    "YouTube",
)

# Site patterns replaced by @URL; the dots are regex wildcards, as in the original.
SITE_PATTERNS = ("Timesnewroman.ro", "www.cautatoriidepovesti.ro")

# Reasoning-model ids (substring match on the lower-cased model name).
REASONING_MODELS = ("o3", "o3-mini", "o3-pro", "o4-mini", "o1", "o1-mini", "o1-preview", "o1-pro")

# Tokens kept although they are short.
KEEP_SHORT_TOKENS = ("<", ">")

# Retry policy for rate-limited scoring calls.
MAX_TRIES = 5

# --- end of fixed values ----------------------------------------------------

LABEL_DOMAIN = (0, 1)
INVALID = -1
SPLITS = ("train", "validation", "test")
DOMAINS = ("life-death", "it-stiinta", "cronica-de-film")
