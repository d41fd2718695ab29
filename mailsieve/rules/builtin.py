"""The built-in rule pack: one row for each provider.

A provider is known by its hosts, with all their subdomains; 'name.*' is a name under any country's or
generic suffix.  A path narrows it.  Links of a wrapper lead to what a parameter of the query holds, or to what
follows a part of the path.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Row(NamedTuple):
    name: str
    hosts: str = ""  # none: any host
    path: str = ""  # pattern of what follows the host
    params: str = ""
    query: tuple[str, str] | None = None  # path pattern and parameter that holds a link's target
    via: str = ""  # other hosts whose links lead there in the same way
    after: str = ""  # pattern of a path, its group the target
    exact: bool = False  # no subdomains
    beacon: bool = False  # images from here are beacons


# The names of tracking parameters on all sites, of providers, of their hosts and of their parameters.
GLOBAL_PARAMS = """
utm_.* fbclid gclid dclid msclkid twclid igshid rb_clickid vero_id vero_conv mc_cid mc_eid mkt_tok _hsenc _hsmi hsa_.*
hsCtaTracking ga_(source|medium|term|content|campaign) pk_campaign pk_kwd piwik_campaign piwik_kwd mtm_.* spm ref_src
elq elqak elqaid elqat elqtrackid elqcampaignid elqcontactid elqrecipientid msdynmkt_target msdynmkt_digest
msdynmkt_secretversion msdynmkt_contextid msdynmkt_requestid smlid smclient smconv smid ck_subscriber_id _x_tr_.* ito
Echobox mostrecentleadsource ahoy_click
""".split()
ROWS = [
    Row("amazon", "amazon.* amzn.to", params="ref ref_ p[fd]_rd_[a-z]* _encoding psc qid srs? sprefix crid dib dib_tag content-id linkcode tag ascsubtag smid spia linkid creativeasin creative camp", query=("/gp/r[.]html", "U")),
    Row("youtube", "youtube.com youtube-nocookie.com youtu.be", params="si feature pp kw"),
    Row("ebay", "ebay.*", params="_trkparms _trksid _from hash ul_noapp mkcid mkrid mkevt campid toolid customid siteid amdata"),
    Row("google", "google.*", params="ved ei gs_l gs_lcp sa oq sclient uact sxsrf gws_rd gbv sourceid dpr", query=("/url", "url|q")),
    Row("googleplay", "play.google.com", exact=True, params="referrer"),
    Row("twitter", "twitter.com x.com t.co", params="s t ref_src ref_url cn refsrc"),
    Row("facebook", "facebook.com fb.com fb.watch", params="mibextid comment_tracking rdid share_url refsrc hrc", query=("/l[.]php", "u")),
    Row("instagram", "instagram.com", params="igsh img_index"),
    Row("linkedin", "linkedin.com lnkd.in", params="trk trkinfo trkEmail originalsubdomain midtoken midSig _sig lipi eid otptoken li_fat_id refid"),
    Row("reddit", "reddit.com redd.it", params="share_id correlation_id ref_source ref_campaign rdt web_only deep_link", query=("/[^?#]*", "url"), via="redditmail.com"),
    Row("tiktok", "tiktok.com", params="_t _r is_copy_url is_from_webapp sender_device sender_web_id"),
    Row("spotify", "spotify.com", params="si nd context"),
    Row("aliexpress", "aliexpress.com aliexpress.us", params="spm scm pvid algo_pvid algo_expid btsid ws_ab_test gatewayadapt"),
    Row("medium", "medium.com", params="source sk"),
    Row("github", "github.com", params="email_source email_token"),
    Row("paypal", "paypal.*", params="link_ref unptid calc unp_tpcid xt xe"),
    Row("mautic", path="/r/[a-f0-9]{16,}(?:[/?]|$)", params="ct"),
    Row("twitch-email", "twitch.tv", params="tt_content tt_medium tt_email_id ignore_query"),
    Row("twitch-spade", "spade.twitch.tv", exact=True, beacon=True),
    Row("sendgrid", "sendgrid.net", query=("/ls/click", "url")),
    Row("sendgrid_branded", path="/ls/click[?]", query=("/ls/click", "url")),
    Row("hubspot", "hubspotlinks.com hs-sites.com hubspotemail.net", query=("/c", "url")),
    Row("mailchimp", "list-manage.com", path="/track/click"),
    Row("mandrill", "mandrillapp.com", path="/track/click", query=("/track/click[^?#]*", "url")),
    Row("constantcontact", "rs6.net", path="/tn[.]jsp"),
    Row("iterable", "links.iterable.com", exact=True, query=("/[^?#]*", "url")),
    Row("klaviyo", "klaviyo.com klclick.com", query=("/[^?#]*", "url")),
    Row("sparkpost", "spgo.io", query=("/[^?#]*", "url")),
    Row("postmark", "pstmrk.it"),
    Row("mailgun", "mailgun.org", query=("/[^?#]*", "url")),
    Row("salesmanago", "salesmanago.com"),
    Row("awstrack", "awstrack.me", after="/L0/(https?[:%][^/]+)"),
    Row("clicktrack-b64-path", path="/(?:[^/]+/)*aHR0c", after="/(?:[^/]+/)*?(aHR0c[A-Za-z0-9+_=-]+)"),
    Row("clicktrack-cl0", path="/CL0/https?[:%]", after="/CL0/(https?[:%][^/]+)"),
    Row("mailjet", "mjt.lu", path="/lnk/"),
    Row("sendinblue-alt", "sendibm1.com"),
    Row("azure-safelink", "safelink.emails.azure.net", path="/redirect", query=("/redirect/?", "destination")),
    Row("customerio-click", path="/e/c/eyJ", after="/e/c/(eyJ[A-Za-z0-9+_=-]+)"),
    Row("customerio-pixel", "customeriomail.com", path="/e/o/", beacon=True),
    Row("parcellab", "versand-status.de", path="/click/", query=("/click/[^/]+/forward", "to")),
    Row("dynamics365-click", "public-[a-z]+.mkt.dynamics.com", exact=True),
    Row("dynamics365-pixel", "assets-[a-z]+.mkt.dynamics.com", exact=True, beacon=True),
    Row("doubleclick", "doubleclick.net", beacon=True),
    Row("google-analytics", "google-analytics.com", beacon=True),
    Row("googletagmanager", "googletagmanager.com", beacon=True),
    Row("convertkit", "open.convertkit-mail.com click.convertkit-mail.com", exact=True, beacon=True),
    Row("krxd", "krxd.net", beacon=True),
    Row("mathtag", "mathtag.com", beacon=True),
    Row("linkedin-px", "px.ads.linkedin.com", exact=True, beacon=True),
    Row("pinterest-ct", "ct.pinterest.com", exact=True, beacon=True),
    Row("activecampaign", "trackcmp.net", beacon=True),
    Row("eloqua", "en25.com", beacon=True),
    Row("sendtric-pixel", "sendtric.com", beacon=True),
]


def site(row: Row) -> str:
    """A pattern for the host, up to its end."""
    if not row.hosts:
        return "^https?://[^/?#]+"
    names = [re.sub("[.](?=[a-z])", "[.]", h.removesuffix(".*")) + ("(?:[.][a-z]{2,})+" if h.endswith(".*") else "") for h in row.hosts.split()]
    below = "" if row.exact else "(?:[a-z0-9_-]+[.])*"
    return f"^https?://{below}(?:{'|'.join(names)})"


def redirections(row: Row) -> list[str]:
    rest = "[?](?:[^#]*?&)?(?:{})=([^&#]+)".format(row.query[1]) if row.query else ""
    path = row.query[0] + rest if row.query else row.after
    return [f"{site(x)}(?::[0-9]+)?{path}" for x in (row, row._replace(hosts=row.via)) if path and (x is row or x.hosts)]


def pack() -> dict:
    """The pack in the provider format that the loader reads."""
    out: dict = {"globalRules": {"urlPattern": "^https?://", "rules": GLOBAL_PARAMS}}
    for row in ROWS:
        rest = f"(?::[0-9]+)?{row.path}" if row.path else "(?:[:/?#]|$)"
        out[row.name] = {"urlPattern": site(row) + rest, "rules": row.params.split(), "completeProvider": row.beacon}
        if found := redirections(row):
            out[row.name]["redirections"] = found
    return {"providers": out}
