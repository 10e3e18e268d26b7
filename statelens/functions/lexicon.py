"""Word lists that results depend on."""

from __future__ import annotations

# The stopwords, synonyms and terms that must be these for equal results, in their given order.
EVENT_STOPWORDS = ("the", "a", "an", "to", "for", "and", "or", "of", "on", "in", "by", "with", "from", "user", "system")
EVENT_SYNONYMS = {
    "login": "authenticate", "signin": "authenticate", "sign": "authenticate", "authorization": "authorize", "authorise": "authorize",
    "approval": "approve", "accepted": "approve", "accept": "approve", "decline": "reject", "deny": "reject",
    "failed": "fail", "failure": "fail", "error": "fail", "signout": "logout", "cancelled": "cancel", "canceled": "cancel", "abort": "cancel",
    "pay": "payment", "paid": "payment", "purchase": "payment", "billing": "payment", "registration": "register",
    "view": "access", "open": "access", "select": "access", "choose": "access", "send": "submit", "reattempt": "retry",
}
RATING_STOPWORDS = ("a", "about", "access", "after", "all", "allow", "allows", "an", "and", "are", "as", "at", "be", "by", "can", "complete", "do", "for", "from", "if", "in", "into", "is", "it", "of", "on", "or", "shall", "system", "the", "their", "to", "user", "users", "when", "with")
REQUIREMENT_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those", "it", "its", "as", "at", "from", "into", "than", "then", "if", "when", "while",
    "can", "will", "shall", "should", "would", "could", "may", "might", "must", "not", "no", "so", "such", "their", "his", "her", "our", "your", "they", "them", "he", "she", "we", "you", "i",
)
DOMAIN_TERMS = ("accounts", "admin", "inventory", "logistic", "logistics", "order", "payment", "authentication", "employee", "employees", "customer", "customers", "healthcare", "covid", "textile", "marketplace", "device", "recommendation")
CAPABILITY_VERBS = ("allow", "allows", "enable", "enables", "support", "supports", "generate", "generates", "calculate", "calculates", "notify", "notifies", "update", "updates", "manage", "manages", "monitor", "monitors", "track", "tracks", "operate", "operated", "submit", "submitted", "cancel", "cancelled", "pass", "passed", "regulate", "regulated", "detect", "detection", "warn", "stock", "view", "check", "log", "register", "issue", "search", "replace", "remove", "add", "place", "create", "select", "selects", "order", "orders", "provide", "provides", "fill", "fills", "upload", "uploads", "verify", "verifies", "purchase", "purchases", "transition", "transitions", "enter", "enters", "reenter", "reenters", "leave", "leaves", "open", "opens", "close", "closes", "press", "presses", "input", "inputs", "expire", "expires", "list", "lists", "serve", "serves", "predict", "predicts", "shortlist", "shortlists", "assess", "assesses", "map", "maps", "alert", "alerts")
AMBIGUOUS_TERMS = ("etc", "and so on", "user friendly", "easy to use", "efficient", "quickly", "some", "many", "appropriate", "suitable", "as needed")
ACTORS = ("inventory managers", "inventory manager", "salespersons", "salesperson", "administrators", "administrator", "admin", "customers", "customer", "patients", "patient", "caregivers", "caregiver", "doctors", "doctor", "sellers", "seller", "users", "user", "citizens", "citizen", "students", "student", "drivers", "driver", "donors", "donor", "volunteers", "volunteer", "authorities", "authority", "companies", "company", "employers", "employer", "job seekers", "job seeker")
#: Those of the comparison of candidates: stopwords, and synonyms (words that stand for themselves are left out).
CONCEPT_STOPWORDS = (
    "a", "about", "after", "all", "allow", "allows", "an", "and", "are", "as", "at", "available", "be", "between", "by", "can", "complete", "completed", "current", "different", "do", "does", "during", "each", "enable", "enables", "end", "ensure",
    "for", "from", "if", "in", "into", "is", "it", "of", "on", "or", "process", "provide", "provides", "related", "shall", "should", "support", "supports", "system", "that", "the", "their", "then", "to", "use", "user", "users", "when", "where", "whether", "with",
)
CONCEPT_SYNONYMS = {
    "authenticate": "login", "authenticated": "login", "authentication": "login", "signin": "login", "sign": "login", "logged": "login", "signout": "logout", "register": "registration", "registered": "registration",
    "validate": "validation", "validated": "validation", "validating": "validation", "verify": "validation", "verified": "validation", "verification": "validation", "pay": "payment", "paid": "payment", "payments": "payment",
    "purchases": "purchase", "buy": "purchase", "choose": "select", "chosen": "select", "selected": "select", "display": "view", "show": "view", "shown": "view", "read": "view", "finished": "finish",
    "failure": "fail", "failed": "fail", "fails": "fail", "invalid": "fail", "cancelled": "cancel", "canceled": "cancel",
}
#: What a requirement in "The system shall" form is told by: verbs and actors that it may begin with, and copulas anywhere.
SHALL_VERBS = (
    "allow", "allows", "enable", "enables", "support", "supports", "provide", "provides", "manage", "manages", "monitor", "monitors", "track", "tracks", "detect", "detects", "verify", "verifies", "register", "registers",
    "log", "logs", "view", "views", "create", "creates", "update", "updates", "cancel", "cancels", "search", "searches", "order", "orders", "select", "selects",
)
SHALL_ACTORS = ("user", "users", "customer", "customers", "patient", "patients", "admin", "administrator", "driver", "citizen", "student")
SHALL_COPULAS = ("is", "are", "will be", "shall be")
#: Words that a clause may begin with and loses.
CONNECTIVES = ("however", "hence", "furthermore", "therefore", "moreover", "in addition", "on one hand", "on the other hand", "as a result", "before it", "next", "then", "if instead")
