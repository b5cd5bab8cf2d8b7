"""Rules over plain text: no look-around, ASCII classes only, so that regex engines agree."""

from rivulant.rules import Rename, Rule

TEXT_RULES = (
    Rule("secret_token", 'token = "[0-9a-f]+"', "high", "credential in the text"),
    Rule("email", "[A-Za-z0-9.]+@[A-Za-z0-9.]+", "high", "mail address"),
    Rule("long_number", "[0-9]{12,}", "medium", "digit run of card or account length"),
    Rule("license_line", "License", "medium", "licence statement"),
    Rule("shouting", "[A-Z]{4,}!!", "low", "shouted word"),
    Rule("symbol_noise", "[#$%&*]{3}", "low", "run of symbols"),
)

REDACTIONS = (
    Rename('token = "[0-9a-f]+"', 'token = "<hidden>"', "token hidden"),
    Rename("[A-Za-z0-9.]+@[A-Za-z0-9.]+", "<mail>", "mail hidden"),
    Rename("[0-9]{12,}", "<number>", "number hidden"),
    Rename("[#$%&*]{3}", "", "symbol run removed"),
)
