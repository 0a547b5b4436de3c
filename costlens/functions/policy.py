"""The tag policy and the fixed vocabularies of billing exports."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default policy's tags with their synonyms, most specific first.
DEFAULT_TAGS = [
    ("owner", "Owner", ["owner", "ownedby", "owneremail", "contact", "responsible", "creator"]),
    ("team", "Team", ["team", "squad", "teamname", "group", "owningteam", "department", "dept", "businessunit", "bu", "orgunit"]),
    ("environment", "Environment", ["environment", "env", "stage", "envname"]),
    ("cost_center", "Cost center", ["costcenter", "costcentre", "cc", "billingcode", "costcode"]),
]
# Texts that stand for no value.
NULL_TOKENS = [
    "", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "tbd", "todo", "?", "-", "--", "not set", "notset", "unset", "missing", "empty", "no value", "novalue", "nobody", "no owner",
]
# Charge types that cannot carry tags, in normal form.
UNTAGGABLE = ["tax", "credit", "refund", "fee", "rifee", "savingsplanrecurringfee", "savingsplanupfrontfee", "purchase", "adjustment", "unusedreservation", "unusedsavingsplan"]
# Names of one environment.
ENV_ALIASES = [["prod", "production", "prd", "live"], ["dev", "development"], ["stage", "staging", "stg"], ["test", "testing", "qa"], ["uat", "acceptance"]]
# Header names of the roles in normal form, most specific first.
ROLE_SYNONYMS = {
    "resourceId": ["resourceid", "resource", "id", "arn", "resourcearn", "resourcename", "instanceid", "lineitemresourceid"],
    "service": ["service", "servicename", "metercategory", "productservicecode", "product", "productname", "productproductname", "lineitemproductcode", "servicecategory"],
    "provider": ["provider", "providername", "cloud", "cloudprovider", "csp", "vendor", "platform"],
    "region": ["region", "regionid", "regionname", "productregion", "location", "resourcelocation", "availabilityzone", "az"],
    "cost": ["monthlycost", "cost", "unblendedcost", "lineitemunblendedcost", "amortizedcost", "pretaxcost", "costinbillingcurrency", "billedcost", "effectivecost", "amount", "spend", "totalcost"],
    "currency": ["currency", "currencycode", "lineitemcurrencycode", "billingcurrency", "billingcurrencycode"],
    "chargeType": ["chargetype", "chargecategory", "lineitemlineitemtype", "lineitemtype", "chargeclass"],
}
# Labels of the grades, for spend and for resources.
SPEND_LABELS = {"A": "Allocation-ready", "B": "Minor unallocated spend", "C": "Material unallocated spend", "D": "Allocation at risk", "F": "Mostly unallocated"}
RESOURCE_LABELS = {"A": "Strong policy compliance", "B": "Minor compliance gaps", "C": "Material compliance gaps", "D": "Low policy compliance", "F": "Widespread non-compliance"}
DIVERGENCE_POINTS = 15
NO_SERVICE = "(no service)"


@dataclass(frozen=True)
class Tag:
    key: str
    label: str
    synonyms: tuple[str, ...]


@dataclass(frozen=True)
class Policy:
    tags: tuple[Tag, ...] = tuple(Tag(k, n, tuple(s)) for k, n, s in DEFAULT_TAGS)
    null_tokens: tuple[str, ...] = tuple(NULL_TOKENS)


@dataclass(frozen=True)
class Mapping:
    """Which source column plays which role; a tag is read from a column, a key of the JSON column, or both (JSON first)."""

    roles: dict[str, str] = field(default_factory=dict)
    tag_columns: dict[str, str] = field(default_factory=dict)
    json_column: str | None = None
    json_keys: dict[str, str] = field(default_factory=dict)

    def tracked(self, policy: Policy) -> list[str]:
        """Mandatory tags that are mapped, in policy order."""
        return [t.key for t in policy.tags if self.tag_columns.get(t.key) or self.json_keys.get(t.key)]
