"""Patterns of failed logins, in Java's dialect.

Fixed values: the wording of the two daemons. White space is spelled out, because Java's \\s also holds the vertical tab;
(?d) lets . stop at \\n only; \\z is the very end.
"""

WS = r"[\t\n\f\r ]"
NS = r"[^\t\n\f\r ]"
STAMP = r"[A-Za-z]{3} +[0-9]{1,2} +[0-9]{2}:[0-9]{2}:[0-9]{2}"
PREFIX = rf"^{STAMP}{WS}+{NS}+{WS}+sshd(?:\(pam_unix\))?\[[0-9]+\]:{WS}+"  # stamp, host, daemon: five words

PAM = rf"(?d)^authentication failure;.*?\brhost=({NS}+?)(?:{WS}+user=({NS}+))?{WS}*\z"  # source, user
SSH = rf"(?d)^Failed password for (?:invalid user{WS}+)?({NS}+) from ({NS}+) port [0-9]+ ssh2{WS}*\z"  # user, source
REPEATED = rf"(?d)^message repeated ([0-9]+) times:{WS}+\[{WS}*(.+?){WS}*\]{WS}*\z"  # count, inner
