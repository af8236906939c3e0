"""The rule catalog as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# (?U) Unicode classes and boundaries, (?d) only \n ends a line, (?iu) Unicode case folding; S is the white space that
# Java's Unicode \s lacks.
S = r"[\s\x1c-\x1f]"
NOT_S = r"\s\x1c-\x1f"


@dataclass(frozen=True)
class Rule:
    """pattern: (prefix)(value)suffix; needs, gate: every match holds one of these literals or something that gate matches."""

    id: str
    kind: str
    pattern: str
    score: float
    label: str = "secret"
    needs: str | tuple[str, ...] = ()
    gate: str | None = None
    reasons: list[str] = field(default_factory=lambda: ["regex_pattern_match"])
    modes: tuple[str, ...] = ("high_recall", "balanced", "high_precision")
    checked: bool = True


def _key(id_: str, value: str, needs: str | tuple[str, ...]) -> Rule:
    return Rule(id_, "api_key", f"(?Ud)()({value})", 0.9, needs=needs)


_url = ["regex_pattern_match", "url_param_match"]
_otp = rf"(?:动态口令|初始动态口令|一次性口令|一次性密码|验证码|校验码|短信码|OTP|MFA code|verification code|passcode%s){S}*(?:is|are|for|为|是|=)?{S}*(?::|：)?{S}*"
_otp_words = ("口令", "密码", "验证码", "校验码", "短信码")

# The shapes, scores and reason codes of each kind of secret.
SECRET_RULES = [
    _key("R1", r"sk[-_][A-Za-z0-9_-]{12,}", "sk"),
    _key("R2", r"github_pat_[A-Za-z0-9_]{20,}", "github_pat_"),
    _key("R3", r"gh[pousr]_[A-Za-z0-9]{12,}", "gh"),
    _key("R4", r"\b(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16}\b", ("A3T", "AKIA", "ASIA", "ABIA", "ACCA")),
    _key("R5", r"hf_[A-Za-z0-9_-]{16,}", "hf_"),
    _key("R6", r"xoxb-[0-9A-Za-z-]{50,}", "xoxb-"),
    _key("R7", r"xoxp-[0-9A-Za-z-]{71,}", "xoxp-"),
    _key("R8", r"xoxa-[0-9A-Za-z-]{50,}", "xoxa-"),
    _key("R9", r"whsec_[0-9a-zA-Z_]{20,}", "whsec_"),
    _key("R10", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}", "SG."),
    _key("R11", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", "pypi-AgEIcHlwaS5vcmc"),
    _key("R12", r"npm_[A-Za-z0-9_]{36,}", "npm_"),
    _key("R13", r"AIza[A-Za-z0-9_-]{35,}", "AIza"),
    _key("R14", r"[MN][A-Za-z\d_-]{23,25}\.[A-Za-z\d_-]{6,7}\.[A-Za-z\d_-]{27}", "."),
    _key("R15", r"key-[0-9a-z]{32}", "key-"),
    Rule("R16", "bearer", rf"(?iuUd)(Bearer{S}+)([A-Za-z0-9._=-]{{12,}})", 0.8, gate="(?iu)bearer"),
    Rule("R17", "jwt", r"(?Ud)()(\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b)", 0.9, needs="eyJ"),
    Rule("R18", "oauth_code", r"(?iuUd)([?&]code=)([A-Za-z0-9_-]{20,200})", 0.8, reasons=_url, needs="="),
    Rule("R19", "aws_signature", r"(?iuUd)(X-Amz-Signature=)([a-f0-9]{64})", 0.85, reasons=_url, needs="="),
    Rule("R20", "aws_signature", r"(?iuUd)([?&]Signature=)([A-Za-z0-9%+/]{40,})", 0.85, reasons=_url, needs="="),
    Rule(
        "R21",
        "webhook_url",
        r"(?iuUd)(https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8,12}/)([a-zA-Z0-9_]{24})",
        0.85,
        needs="://",
    ),
    Rule("R22", "session", rf"(?iuUd)((?:Set-Cookie:{S}*)?(?:sessionid|session|connect\.sid|sid)=)([^;{NOT_S}]{{8,}})", 0.8, needs="="),
    Rule(
        "R23",
        "db_connection",
        rf"(?iuUd)(\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?)://[^:{NOT_S}]+:)([^@{NOT_S}]+)@[^/{NOT_S}]+/[^{NOT_S}]+",
        0.9,
        needs="://",
    ),
    Rule(
        "R24",
        "private_key",
        r"(?Ud)()(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----)",
        0.95,
        needs="PRIVATE KEY",
        reasons=["regex_pattern_match", "pem_block_match"],
    ),
    Rule(
        "R25",
        "webhook_secret",
        rf"(?iuUd)(\b(?:webhook_secret|signing_secret|client_secret|app_secret){S}*[:=]{S}*)([A-Za-z0-9._-]{{8,}})",
        0.9,
        gate="(?iu)_secret",
    ),
    Rule(
        "R26",
        "token",
        rf"(?iuUd)(\b(?:token|api[_-]?key|access[_-]?token|refresh[_-]?token){S}*[:=]{S}*)([A-Za-z0-9._-]{{10,}})",
        0.75,
        modes=("high_recall", "balanced"),
        gate="(?iu)token|key",
    ),
    Rule(
        "R27",
        "verification_code",
        f"(?iuUd)({_otp % '|code'})([A-Za-z0-9-]{{4,10}})",
        0.65,
        reasons=["regex_pattern_match", "context_match"],
        modes=("high_recall",),
        checked=False,
        needs=_otp_words,
        gate="(?iu)code|otp",
    ),
    Rule(
        "R28",
        "verification_code",
        f"(?iuUd)({_otp % ''})([A-Za-z0-9-]{{4,10}})",
        0.65,
        reasons=["regex_pattern_match", "context_match"],
        modes=("balanced",),
        checked=False,
        needs=_otp_words,
        gate="(?iu)code|otp",
    ),
]

# Personal data.
PII_RULES = [
    Rule(
        "P1",
        "cn_id_number",
        r"(?Ud)()(\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b)",
        0.9,
        "pii",
        checked=False,
        needs=("19", "20"),
    ),
    Rule("P2", "cn_passport", r"(?Ud)()(\b[EeGgDdSsPpHh]\d{8}\b)", 0.85, "pii", checked=False, gate=r"\p{Nd}{8}"),
    Rule("P3", "cn_phone", r"(?Ud)()((?<!\d)1[3-9]\d{9}(?!\d))", 0.8, "pii", checked=False, gate=r"\p{Nd}{9}"),
    Rule("P4", "email", r"(?Ud)()([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 0.85, "pii", needs="@", checked=False),
    Rule("P5", "housing_fund_account", r"(?Ud)((?:公积金账号|公积金帐号|公积金账户|公积金帐户)\D{0,40}?)(\d{10,14})", 0.85, "pii", needs="公积金", checked=False),
    Rule(
        "P6",
        "cn_person_field",
        rf"(?Ud)((?:姓名|联系人|收件人|客户姓名|户名){S}*(?:[:：]{S}*|{S}*[|｜]{S}*|{S}+))([\x{{4e00}}-\x{{9fff}}]{{2,4}})(?=$|[{NOT_S}|｜，,。；;])",
        0.72,
        "private_person",
        reasons=["regex_pattern_match", "field_context_match"],
        checked=False,
        needs=("姓名", "联系人", "收件人", "户名"),
    ),
]
