"""Domain vocabularies.

Fixed values: the alias maps, queues, SLA hours, weights and phrases below must hold exactly these entries
for results to agree with the system this library replaces.
"""

# Category aliases.
CATEGORY_ALIASES = {
    "billing": "Billing",
    "payment": "Billing",
    "invoice": "Billing",
    "charge": "Billing",
    "technical": "Technical",
    "bug": "Technical",
    "error": "Technical",
    "issue": "Technical",
    "account": "Account",
    "login": "Account",
    "password": "Account",
    "shipping": "Shipping",
    "delivery": "Shipping",
    "return": "Returns",
    "refund": "Returns",
    "product": "Product",
    "feature": "Product",
}

# Priority aliases; anything else is P3.
PRIORITY_ALIASES = {
    "critical": "P1",
    "urgent": "P1",
    "high": "P2",
    "medium": "P3",
    "normal": "P3",
    "low": "P4",
    "1": "P1",
    "2": "P2",
    "3": "P3",
    "4": "P4",
}
DEFAULT_PRIORITY = "P3"
PRIORITIES = ["P1", "P2", "P3", "P4"]

# Suggested queue per category.
QUEUES = {
    "Billing": "billing-team",
    "Technical": "tech-support",
    "Account": "account-team",
    "Shipping": "logistics",
    "Returns": "returns-team",
    "Product": "product-support",
    "Escalation": "senior-support",
}
DEFAULT_QUEUE = "general-support"

# Hours to resolve, per priority.
SLA_HOURS = {"P1": 4, "P2": 8, "P3": 24, "P4": 48}
DEFAULT_SLA_HOURS = 24

# Draft rubric weights.
RUBRIC_WEIGHTS = {
    "correctness": 0.25,
    "completeness": 0.20,
    "tone": 0.15,
    "actionability": 0.20,
    "citation": 0.20,
}
DEFAULT_SCORE = 3

# Hedging phrases, matched case-insensitively.
HEDGING_PHRASES = ["I believe", "I think", "probably", "might be", "it seems", "possibly"]

# Confidence level to base score.
BASE_CONFIDENCE = {"high": 0.85, "medium": 0.6, "low": 0.3}
DEFAULT_BASE_CONFIDENCE = 0.5

# Allowed ticket states and the two that count as resolved.
TICKET_STATUSES = ["open", "pending", "resolved", "closed"]
RESOLVED_STATUSES = ["resolved", "closed"]

# Scores when no trained model is at hand.
UNFITTED_CATEGORY = "General"
UNFITTED_PRIORITY = "P3"
UNFITTED_CONFIDENCE = 0.5

# Weight of a term occurrence by field class.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

# The public English stop-word list of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Our own reply texts per category, used when no generated draft is available.
REPLY_TEMPLATES = {
    "Billing": "Hello,\n\nwe have received your billing question and are checking the charge on your account. "
    "Please send the invoice number so that we can compare the amounts.\n\nThe billing desk",
    "Technical": "Hello,\n\nwe are looking into the technical problem you describe. Please tell us the steps that "
    "lead to it and the exact message on the screen.\n\nThe technical desk",
    "Account": "Hello,\n\nwe are happy to help with your account. For your protection we first confirm who you are: "
    "please answer from the address that is registered with us.\n\nThe account desk",
    "default": "Hello,\n\nyour request has reached us and a colleague is reading it now. If it cannot wait, answer "
    "this message with the details.\n\nThe support desk",
}
