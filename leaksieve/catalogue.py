"""The rule catalogue: what a secret looks like.

A rule is one regular expression of the form ``(left context)(value)``. Group 1
always takes part in the match (it may be empty), group 2 is the reported value,
and nothing to the right of the value is consumed, so that neighbouring secrets
stay visible. Regexes stay inside the dialect that ``java.util.regex`` and RE2
read alike: no look-around, no ``\\b``, no repeat above 1000.

Every rule may name cheap *gates*, conditions that its regex implies:

``shape``    name of a shared regex in ``SHAPES`` that begins with a single rare
             character class, so a whole text is rejected in one quick pass
``literal``  case-sensitive substring
``words``    lower-case substrings, one of which must occur in the lower-cased text
``in_name``  the word must occur in a name that something long is assigned to, see
             ``NAMES``: dozens of words are then sought in a few names, not in the text
``tail``     a regex of the rule's own that begins with its rarest character

A gate never changes a result. It only decides whether the costly regex runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Order of preference when several rules hit one span, see ``best_rule``.
KIND_RANK = {"fixed": 0, "keyword": 1, "generic": 2}

# Shared gates, run once per text whatever the number of rules behind them.
SHAPES = {
    # an assignment operator followed by a run long enough to be a credential
    "assign": r"""[=:]>?[ \t]{0,4}["']?[A-Za-z0-9%_./+=-]{16}""",
    # keys written as prefix-body
    "dash": r"""-[0-9A-Za-z_-]{20}""",
    # keys written as prefix_body
    "underscore": r"""_[0-9A-Za-z_-]{22}""",
    # user:password part of a URI
    "userinfo": r"""://[^\s/:@]{0,100}:[^\s/@]{3}""",
    # NAME_KEY=..., NAME_TOKEN=..., NAME_SECRET=..., NAME_PASSWORD=...
    "dotenv": r"""[YNTD]=["']?[^\s"']{8}""",
    "bearer": r"""[Rr][ \t]{1,4}[A-Za-z0-9_.~+/=-]{16}""",
    # the end of "Basic", any case, and credentials
    "basic": r"""[Cc](?<=[Aa][Ss][Ii][Cc])[ \t]{1,4}[A-Za-z0-9+/]{8}""",
    # an assignment operator followed by a quote and no blank
    "quoted": r"""[=:]>?[ \t]{0,4}["'`][^\s"'`]{8}""",
}

# The names, or their last 100 characters, before an assignment of eight characters or more. Every rule that is ``in_name``
# ends its left context with one. The search begins at the operators, which are rare, and looks ahead before it looks behind.
NAMES = (
    r"""[=:](?=[=>]?[ \t]{0,4}["'`]?[^\s"'`]{8})"""
    r"""(?<=((?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{1,99}|[A-Za-z0-9_.-]{100})["']?[ \t]{0,4}[=:])"""
)

# One pass that every shape above implies. It starts with a single character class,
# so most positions of a text cost one comparison.
ANY_SHAPE = (
    r"""[=:_rRcC-](?:(?<![rRcC])>?[ \t]{0,4}["']?[A-Za-z0-9%_./+=-]{16}"""
    r"""|(?<=[rR])[ \t]{1,4}[A-Za-z0-9_.~+/=-]{16}"""
    r"""|(?<=:)//[^\s/:@]{0,100}:[^\s/@]{3}"""
    r"""|(?<=[YNTD]=)["']?[^\s"']{8}"""
    r"""|(?<=[=:])>?[ \t]{0,4}["'`][^\s"'`]{8}"""
    r"""|(?<=[Aa][Ss][Ii][Cc])[ \t]{1,4}[A-Za-z0-9+/]{8})"""
)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    type: str
    family: str
    regex: str
    kind: str = "fixed"
    shape: str | None = None
    literal: str | None = None
    words: tuple[str, ...] = ()
    tail: str | None = None
    bounded: bool = False  # drop matches followed by a letter, digit or underscore
    followed: str = ""  # drop matches that this character doesn't follow
    target: str = "text"  # "uri" rules look at the name of the unit instead
    in_name: bool = False  # the words occur in the name before an assignment

    @property
    def rank(self) -> int:
        return KIND_RANK[self.kind]


def _fixed(rule_id: str, type_: str, family: str, regex: str, **gates) -> Rule:
    return Rule(rule_id, type_, family, regex, **gates)


# ---------------------------------------------------------------------------
# Formats that the issuing services or standards publish.
# ---------------------------------------------------------------------------
_WORD_START = r"(?:^|[^A-Za-z0-9])"
_ASSIGN = r"""["']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}["']?"""
# header lines of a key block, each on a line of its own
_HEADERS = r"(?:[ \t]{0,4}[\r\n]{1,4}[A-Za-z][A-Za-z0-9-]{0,40}:[^\r\n]{0,}){0,}"
_ASSIGN1 = r"""["']?[ \t]{0,4}[:=][ \t]{0,4}["']?"""

FIXED_RULES: tuple[Rule, ...] = (
    _fixed("aws_access_key_id", "AWS Access Key ID", "aws", r"()((?:AKIA|ASIA)[0-9A-Z]{16})", literal="IA", bounded=True),
    _fixed(
        "aws_secret_key", "AWS Secret Key", "aws",
        rf"((?i:{_WORD_START}aws[A-Za-z0-9_.-]{{0,20}}secret[A-Za-z0-9_.-]{{0,20}}){_ASSIGN})([A-Za-z0-9/+]{{40}})",
        shape="assign", in_name=True, words=("aws",), bounded=True,
    ),
    _fixed(
        "aws_session_token", "AWS Session Token", "aws",
        rf"((?i:{_WORD_START}aws[A-Za-z0-9_.-]{{0,20}}session[A-Za-z0-9_.-]{{0,20}}){_ASSIGN})([A-Za-z0-9/+=]{{100,}})",
        shape="assign", in_name=True, words=("aws",),
    ),
    _fixed(
        "aws_mws", "AWS MWS Key", "aws",
        r"()(amzn[.]mws[.][0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", literal="amzn.mws.",
    ),
    _fixed(
        "aws_s3_url", "AWS S3 URL", "aws",
        r"()((?:https?://)?[a-z0-9][a-z0-9.-]{1,61}[a-z0-9][.]s3(?:[.-][a-z0-9-]{2,20})?[.]amazonaws[.]com)",
        literal=".amazonaws.com",
    ),
    _fixed("google_api_key", "Google API Key", "google", r"()(AIza[0-9A-Za-z_-]{35})", literal="AIza", bounded=True),
    _fixed(
        "google_oauth_id", "Google OAuth Client ID", "google",
        r"()([0-9]{1,20}-[0-9A-Za-z_]{32}[.]apps[.]googleusercontent[.]com)",
        shape="dash", literal=".apps.googleusercontent.com",
    ),
    _fixed("google_oauth_secret", "Google OAuth Client Secret", "google", r"()(GOCSPX-[0-9A-Za-z_-]{28})", shape="dash", literal="GOCSPX-", bounded=True),
    _fixed("google_oauth_token", "Google OAuth Access Token", "google", r"((?:^|[^0-9A-Za-z]))(ya29[.][0-9A-Za-z_-]{30,})", literal="ya29."),
    _fixed(
        "gcp_service_account", "GCP Service Account", "google",
        r"""("private_key"[ \t]*:[ \t]*")(-----BEGIN PRIVATE KEY-----[^-"]{1,}-----END PRIVATE KEY-----)""", literal="-----BEGIN ", words=("private_key",),
    ),
    _fixed(
        "facebook_access_token", "Facebook Access Token", "social",
        r"()(EAACEdEose0cBA[0-9A-Za-z]{1,})", literal="EAACEdEose0cBA",
    ),
    _fixed(
        "twitter_access_token", "Twitter Access Token", "social",
        r"((?:^|[^0-9A-Za-z]))([1-9][0-9]{1,20}-[0-9a-zA-Z]{40})",
        shape="dash", tail="-[0-9a-zA-Z]{40}", bounded=True,
    ),
    _fixed("slack_token", "Slack Token", "social", r"()(xox[abeoprs]-[0-9A-Za-z-]{20,})", shape="dash", literal="xox"),
    _fixed("slack_app_token", "Slack App Token", "social", r"()(xapp-[0-9A-Za-z-]{20,})", shape="dash", literal="xapp-"),
    _fixed(
        "slack_webhook", "Slack Webhook URL", "social",
        r"()(https://hooks[.]slack[.]com/services/[A-Za-z0-9]{8,16}/[A-Za-z0-9]{8,16}/[A-Za-z0-9]{20,})",
        literal="://", words=("hooks.slack.com/services/",),
    ),
    _fixed(
        "discord_webhook", "Discord Webhook URL", "social",
        r"()(https://(?:[a-z]{1,10}[.])?discord(?:app)?[.]com/api/webhooks/[0-9]{15,21}/[A-Za-z0-9_-]{60,})",
        literal="://", words=("/api/webhooks/",),
    ),
    _fixed(
        "telegram_bot_token", "Telegram Bot Token", "social",
        r"((?:^|[^0-9A-Za-z]))([0-9]{8,10}:[A-Za-z0-9_-]{35})",
        shape="assign", tail=":[A-Za-z0-9_-]{35}", bounded=True,
    ),
    _fixed("github_token", "GitHub Token", "code_hosting", r"()(gh[opsur]_[0-9A-Za-z]{36})", shape="underscore", literal="gh", bounded=True),
    _fixed(
        "github_fine_grained_token", "GitHub Fine-Grained Token", "code_hosting",
        r"()(github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59})", shape="underscore", literal="github_pat_", bounded=True,
    ),
    _fixed("gitlab_token", "GitLab Token", "code_hosting", r"()(glpat-[0-9A-Za-z_-]{20,})", shape="dash", literal="glpat-"),
    _fixed("stripe_standard_key", "Stripe Standard Key", "commerce", r"()(sk_(?:live|test)_[0-9a-zA-Z]{24,})", shape="underscore", literal="sk_"),
    _fixed("stripe_restricted_key", "Stripe Restricted Key", "commerce", r"()(rk_(?:live|test)_[0-9a-zA-Z]{24,})", shape="underscore", literal="rk_"),
    _fixed("square_access_token", "Square Access Token", "commerce", r"()(sq0atp-[0-9A-Za-z_-]{22})", shape="dash", literal="sq0atp-", bounded=True),
    _fixed("square_oauth_secret", "Square OAuth Secret", "commerce", r"()(sq0csp-[0-9A-Za-z_-]{43})", shape="dash", literal="sq0csp-", bounded=True),
    _fixed(
        "paypal_braintree_token", "PayPal Braintree Token", "commerce",
        r"()(access_token[$]production[$][0-9a-z]{16}[$][0-9a-f]{32})", literal="access_token$production$", bounded=True,
    ),
    _fixed("mailgun_key", "Mailgun Key", "commerce", r"((?:^|[^0-9A-Za-z]))(key-[0-9a-zA-Z]{32})", shape="dash", literal="key-", bounded=True),
    _fixed("mailchimp_key", "Mailchimp Key", "commerce", r"((?:^|[^0-9A-Za-z]))([0-9a-f]{32}-us[0-9]{1,2})", literal="-us", bounded=True),
    _fixed("sendgrid_key", "SendGrid Key", "commerce", r"()(SG[.][0-9A-Za-z_-]{22}[.][0-9A-Za-z_-]{43})", literal="SG.", bounded=True),
    _fixed("shopify_token", "Shopify Token", "commerce", r"()(shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32})", shape="underscore", literal="shp", bounded=True),
    _fixed("openai_key", "OpenAI Key", "platform", r"((?:^|[^0-9A-Za-z]))(sk-(?:proj-)?[0-9A-Za-z_-]{40,})", shape="dash", literal="sk-"),
    _fixed("huggingface_token", "HuggingFace Token", "platform", r"((?:^|[^0-9A-Za-z]))(hf_[0-9A-Za-z]{34})", shape="underscore", literal="hf_", bounded=True),
    _fixed("docker_token", "Docker Token", "platform", r"()(dckr_pat_[0-9A-Za-z_-]{27})", shape="underscore", literal="dckr_pat_", bounded=True),
    _fixed("vault_token", "Vault Token", "platform", r"((?:^|[^0-9A-Za-z]))(hvs[.][0-9A-Za-z_-]{24,})", literal="hvs."),
    _fixed(
        "azure_storage_key", "Azure Storage Key", "enterprise_cloud",
        r"((?i:AccountKey)[ \t]{0,4}=[ \t]{0,4})([A-Za-z0-9/+]{86}==)", shape="assign", in_name=True, words=("accountkey",),
    ),
    _fixed(
        "teams_webhook", "Teams Webhook URL", "enterprise_cloud",
        r"()(https://[a-z0-9-]{1,60}[.]webhook[.]office[.]com/webhookb2/[A-Za-z0-9@/_-]{40,})",
        literal="://", words=(".webhook.office.com/",),
    ),
    _fixed("infura_url", "Infura Project URL", "web3", r"([.]infura[.]io/v3/)([0-9a-f]{32})", literal=".infura.io/v3/", bounded=True),
    _fixed(
        "alchemy_url", "Alchemy App URL", "web3",
        r"([.](?:alchemyapi[.]io|alchemy[.]com)/v2/)([0-9A-Za-z_-]{32})", literal=".alchemy", bounded=True,
    ),
    _fixed(
        "ethereum_private_key", "Ethereum Private Key", "web3",
        rf"((?i:{_WORD_START}(?:eth|ethereum|wallet|private)[A-Za-z0-9_.-]{{0,20}}key){_ASSIGN1})((?:0x)?[0-9a-fA-F]{{64}})",
        shape="assign", in_name=True, words=("key",), bounded=True,
    ),
    _fixed(
        "jwt", "JSON Web Token", "session",
        r"((?:^|[^A-Za-z0-9_-]))(eyJ[A-Za-z0-9_-]{4,}[.]eyJ[A-Za-z0-9_-]{4,}[.][A-Za-z0-9_-]{10,})", literal=".eyJ",
    ),
    _fixed("bearer_token", "Bearer Token", "session", r"((?i:bearer)[ \t]{1,4})([A-Za-z0-9_.~+/=-]{16,})", shape="bearer", words=("bearer",)),
    _fixed(
        "session_cookie", "Session Cookie", "session",
        rf"((?i:{_WORD_START}(?:sessionid|session_id|phpsessid|jsessionid|connect[.]sid)){_ASSIGN1})([A-Za-z0-9%_.-]{{16,}})",
        shape="assign", in_name=True, words=("sess", "connect.sid"),
    ),
    _fixed(
        "csrf_token", "CSRF Token", "session",
        rf"((?i:(?:csrf|xsrf)[_-]?token){_ASSIGN1})([A-Za-z0-9_./+=-]{{16,}})", shape="assign", in_name=True, words=("srf",),
    ),
    # A key is its header, body and end; where the end is missing, the header stands for it.
    _fixed(
        "pem_private_key", "PEM Private Key", "private_key",
        r"()(-----BEGIN (?:RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
        rf"(?:{_HEADERS}[^-]{{1,}}-----END (?:RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----)?)",
        literal="-----BEGIN ",
    ),
    _fixed(
        "pgp_private_key", "PGP Private Key", "private_key",
        rf"()(-----BEGIN PGP PRIVATE KEY BLOCK-----(?:{_HEADERS}[^-]{{1,}}-----END PGP PRIVATE KEY BLOCK-----)?)",
        literal="-----BEGIN ",
    ),
    _fixed(
        "ssh2_private_key", "SSH2 Private Key", "private_key",
        rf"()(---- BEGIN SSH2 (?:ENCRYPTED )?PRIVATE KEY ----(?:{_HEADERS}[^-]{{1,}}---- END SSH2 (?:ENCRYPTED )?PRIVATE KEY ----)?)",
        literal="---- BEGIN SSH2 ",
    ),
    _fixed("basic_auth", "Basic Authorization", "session", r"((?i:authorization)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?(?i:basic)[ \t]{1,4})([A-Za-z0-9+/]{8,}={0,2})", shape="basic", words=("basic",)),
    _fixed("uri_smtp", "SMTP URI Password", "service_uri", r"((?i:smtps?)://[^\s/:@]{1,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("smtp",)),
    _fixed("uri_redis", "Redis URI Password", "service_uri", r"((?i:rediss?)://[^\s/:@]{0,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("redis",)),
    _fixed("uri_amqp", "RabbitMQ URI Password", "service_uri", r"((?i:amqps?)://[^\s/:@]{1,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("amqp",)),
    _fixed("uri_mongodb", "MongoDB URI Password", "service_uri", r"((?i:mongodb(?:[+]srv)?)://[^\s/:@]{1,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("mongodb",)),
    _fixed("uri_postgres", "PostgreSQL URI Password", "service_uri", r"((?i:postgres(?:ql)?)://[^\s/:@]{1,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("postgres",)),
    _fixed("uri_mysql", "MySQL URI Password", "service_uri", r"((?i:mysql)://[^\s/:@]{1,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("mysql",)),
    _fixed("uri_elasticsearch", "Elasticsearch URI Password", "service_uri", r"((?i:https?)://(?i:elastic[A-Za-z0-9_]{0,20}):)([^\s/@]{3,})", followed="@", shape="userinfo", words=("elastic",)),
    _fixed("uri_http", "HTTP URI Password", "service_uri", r"((?i:https?)://[^\s/:@]{1,100}:)([^\s/@]{3,})", followed="@", shape="userinfo", words=("http",)),
    _fixed(
        "dotenv_assignment", "Dotenv Assignment", "config_file",
        r"""((?:^|[\r\n])[ \t]{0,40}(?:export )?[A-Z][A-Z0-9_]{0,40}(?:KEY|TOKEN|SECRET|PASSWORD)=["']?)([^\s"']{8,})""",
        shape="dotenv", tail="(?:KEY|TOKEN|SECRET|PASSWORD)=", kind="generic",
    ),
    _fixed(
        "generic_secret", "Generic Secret", "generic",
        rf"""((?i:{_WORD_START}(?:api[_-]?key|secret|token|password|passwd))["']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}["'`])([A-Za-z0-9_./+=-]{{16,}})""",
        shape="quoted", in_name=True, tail=r"""[=:>][ \t]{0,4}["'`][A-Za-z0-9_./+=-]{16}""", words=("key", "secret", "token", "passw"), kind="generic",
    ),
    # quoted passwords may hold any character and be short
    _fixed(
        "generic_password", "Generic Password", "generic",
        rf"""((?i:{_WORD_START}(?:[A-Za-z0-9]{{1,20}}_)?(?:password|passwd|pwd))["']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}["'`])([^\s"'`]{{8,}})""",
        shape="quoted", in_name=True, words=("passw", "pwd"), kind="generic",
    ),
    _fixed(
        "critical_config_file", "Critical Config File", "config_file",
        r"((?:^|/))([.]env(?:[.][A-Za-z0-9_-]{1,30})?\z|[.](?:npmrc|pypirc|netrc|pgpass|htpasswd|dockercfg|git-credentials)\z"
        r"|id_(?:rsa|dsa|ecdsa|ed25519)\z|(?:credentials|secrets)[.](?:json|ya?ml|toml)\z|wp-config[.]php\z)",
        target="uri",
    ),
)

# ---------------------------------------------------------------------------
# Services without a public key format of their own. Columns are
# family, service name, service word (regex), literal that the word implies.
# ---------------------------------------------------------------------------
KEYWORD_SERVICES: tuple[tuple[str, str, str, str], ...] = (
    ("google", "Google Maps", "google[_-]?maps", "google"),
    ("google", "Google Analytics", "google[_-]?analytics", "google"),
    ("google", "Firebase", "firebase", "firebase"),
    ("enterprise_cloud", "Azure", "azure", "azure"),
    ("enterprise_cloud", "Office365", "office365", "office365"),
    ("enterprise_cloud", "Teams", "teams", "teams"),
    ("enterprise_cloud", "IBM", "ibm", "ibm"),
    ("enterprise_cloud", "Oracle", "oracle", "oracle"),
    ("enterprise_cloud", "Alibaba", "alibaba", "alibaba"),
    ("enterprise_cloud", "Salesforce", "salesforce", "salesforce"),
    ("enterprise_cloud", "SAP", "sap", "sap"),
    ("code_hosting", "GitHub", "github", "github"),
    ("code_hosting", "GitLab", "gitlab", "gitlab"),
    ("code_hosting", "Bitbucket", "bitbucket", "bitbucket"),
    ("code_hosting", "Atlassian", "atlassian", "atlassian"),
    ("code_hosting", "Copilot", "copilot", "copilot"),
    ("code_hosting", "Runner", "runner", "runner"),
    ("social", "Facebook", "facebook", "facebook"),
    ("social", "Twitter", "twitter", "twitter"),
    ("social", "LinkedIn", "linkedin", "linkedin"),
    ("social", "Discord", "discord", "discord"),
    ("social", "Telegram", "telegram", "telegram"),
    ("social", "Slack", "slack", "slack"),
    ("social", "Zoom", "zoom", "zoom"),
    ("commerce", "Stripe", "stripe", "stripe"),
    ("commerce", "PayPal", "paypal", "paypal"),
    ("commerce", "Square", "square", "square"),
    ("commerce", "Shopify", "shopify", "shopify"),
    ("commerce", "Mailgun", "mailgun", "mailgun"),
    ("commerce", "SendGrid", "sendgrid", "sendgrid"),
    ("commerce", "Mailchimp", "mailchimp", "mailchimp"),
    ("commerce", "Pusher", "pusher", "pusher"),
    ("commerce", "Algolia", "algolia", "algolia"),
    ("commerce", "Sentry", "sentry", "sentry"),
    ("commerce", "Mixpanel", "mixpanel", "mixpanel"),
    ("platform", "OpenAI", "openai", "openai"),
    ("platform", "HuggingFace", "hugging_?face", "hugging"),
    ("platform", "Expo", "expo", "expo"),
    ("platform", "Android", "android", "android"),
    ("platform", "iOS", "ios", "ios"),
    ("platform", "MQTT", "mqtt", "mqtt"),
    ("platform", "Okta", "okta", "okta"),
    ("platform", "ServiceNow", "servicenow", "servicenow"),
    ("platform", "Vault", "vault", "vault"),
    ("platform", "Docker", "docker", "docker"),
    ("platform", "Kubernetes", "kubernetes", "kubernetes"),
    ("platform", "Jenkins", "jenkins", "jenkins"),
    ("platform", "CircleCI", "circle_?ci", "circle"),
    ("platform", "TravisCI", "travis(?:_?ci)?", "travis"),
    ("web3", "Ethereum", "ethereum", "ethereum"),
    ("web3", "Infura", "infura", "infura"),
    ("web3", "Alchemy", "alchemy", "alchemy"),
    ("service", "SMTP", "smtp", "smtp"),
    ("service", "Redis", "redis", "redis"),
    ("service", "RabbitMQ", "rabbitmq", "rabbitmq"),
    ("service", "MongoDB", "mongo(?:db)?", "mongo"),
    ("service", "PostgreSQL", "postgres(?:ql)?", "postgres"),
    ("service", "MySQL", "mysql", "mysql"),
    ("service", "Elasticsearch", "elastic(?:search)?", "elastic"),
    ("hosting", "Cloudflare", "cloudflare", "cloudflare"),
    ("hosting", "Heroku", "heroku", "heroku"),
    ("hosting", "Vercel", "vercel", "vercel"),
    ("hosting", "Netlify", "netlify", "netlify"),
    ("hosting", "Supabase", "supabase", "supabase"),
)

# Service word + credential word + assignment + value.
KEYWORD_TEMPLATE = (
    rf"((?i:{_WORD_START}(?:%s)[A-Za-z0-9_.-]{{0,30}}"
    r"(?:key|token|secret|passwd|password|pwd|credential|auth|dsn|webhook)[A-Za-z0-9_.-]{0,20})"
    rf"{_ASSIGN})([A-Za-z0-9_./+=-]{{16,}})"
)

KEYWORD_RULES: tuple[Rule, ...] = tuple(
    Rule(
        rule_id="kw_" + re.sub(r"[^a-z0-9]+", "_", name.lower()),
        type=f"{name} Credential",
        family=family,
        regex=KEYWORD_TEMPLATE % word,
        kind="keyword",
        shape="assign",
        words=(guard,),
        in_name=True,
    )
    for family, name, word, guard in KEYWORD_SERVICES
)

RULES: tuple[Rule, ...] = FIXED_RULES + KEYWORD_RULES


def rules(spark: SparkSession, catalogue: Sequence[Rule] = RULES) -> DataFrame:
    """The catalogue as a table, for reporting and for joins on ``rule_id``."""
    rows = [(r.rule_id, r.type, r.family, r.kind, r.regex, r.literal or ",".join(r.words)) for r in catalogue]
    return spark.createDataFrame(rows, "rule_id string, type string, family string, kind string, regex string, keyword string")


# Texts on which no rule may match an empty string.
_EMPTY_PROBES = ("", "a", " ", "\n", "a b", "a-b", "=\"'", "A1_")


def _is_left_and_value(regex: str) -> bool:
    """Whether a regex is one capturing group followed by another, and nothing else."""
    # escapes and character classes hold no structure
    bare = re.sub(r"\\[^QE]", "x", regex)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "x", bare)
    depth, ends = 0, []
    for i, char in enumerate(bare):
        depth += (char == "(") - (char == ")")
        if depth == 0:
            ends.append(i)
    return (
        len(ends) == 2 and ends[1] == len(bare) - 1 and bare[ends[0]] == bare[ends[1]] == ")"
        and bare[0] == "(" and bare[1:2] != "?" and bare[ends[0] + 2 : ends[0] + 3] != "?"
    )


def may_span_lines(rule: Rule) -> bool:
    """Whether a value of the rule can hold a line break; in doubt it can."""
    bare = re.sub(r"\\.", "xx", rule.regex)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", lambda m: "x" * len(m.group()), bare)
    depth, end = 0, 0
    for i, char in enumerate(bare):
        depth += (char == "(") - (char == ")")
        if depth == 0:
            end = i + 1
            break
    value = re.sub(r"\[\^\\s[^\]\[\\]*\]", "x", rule.regex[end:])  # no blanks, so no line breaks
    value = re.sub(r"\[[^\]\[\\^][^\]\[\\]*\]", lambda m: "x" if min(m.group()) >= " " else m.group(), value)
    value = re.sub(r"\\[.?+*()|${}-]", "x", value).replace("(?:", "(").replace("(?i:", "(")
    return any(mark in value for mark in ("[", ".", "\\", "(?")) or min(value, default=" ") < " "


def validate(spark: SparkSession, extra: Iterable[Rule]) -> None:
    """Compile custom rules with Spark's own regex functions and check the convention.

    Raises ``ValueError`` for a regex that does not compile, is not of the form
    ``(left context)(value)`` or matches the empty string.
    """
    for rule in extra:
        if not _is_left_and_value(rule.regex):
            raise ValueError(f"rule {rule.rule_id}: regex must be (left context)(value)")
        if rule.kind not in KIND_RANK or rule.target not in ("text", "uri"):
            raise ValueError(f"rule {rule.rule_id}: unknown kind or target")
        if rule.shape is not None and rule.shape not in SHAPES:
            raise ValueError(f"rule {rule.rule_id}: unknown shape {rule.shape!r}")
        probes = spark.createDataFrame([(p,) for p in _EMPTY_PROBES], "p string")
        pattern = F.lit(rule.regex)
        try:
            groups = probes.select(
                F.exists(F.regexp_extract_all("p", pattern, F.lit(0)), lambda m: m == "").alias("empty"),
                # an alternation that always matches, so that group 2 is looked up for certain
                F.regexp_extract("p", f"(?:{rule.regex})|", 2).alias("value"),
            ).collect()
        except Exception as err:
            raise ValueError(f"rule {rule.rule_id}: regex must compile and have two groups") from err
        if any(row.empty for row in groups):
            raise ValueError(f"rule {rule.rule_id}: regex matches the empty string")


def with_rules(spark: SparkSession, base: Sequence[Rule], extra: Sequence[Rule]) -> tuple[Rule, ...]:
    """``base`` plus validated custom rules; a custom rule replaces a base rule of its id."""
    validate(spark, extra)
    merged = {r.rule_id: r for r in base}
    merged.update({r.rule_id: r for r in extra})
    return tuple(merged.values())


def select_rules(
    catalogue: Sequence[Rule], families: Iterable[str] | None = None, rule_ids: Iterable[str] | None = None
) -> tuple[Rule, ...]:
    """Restrict a catalogue to some families and / or rule ids; ``None`` means all."""
    families = None if families is None else set(families)
    rule_ids = None if rule_ids is None else set(rule_ids)
    return tuple(
        r for r in catalogue
        if (families is None or r.family in families) and (rule_ids is None or r.rule_id in rule_ids)
    )
