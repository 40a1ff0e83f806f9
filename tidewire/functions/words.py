"""Fixed word lists, in alphabetical order."""

from __future__ import annotations

# English stop words.
ENGLISH = frozenset(
    {
        "a", "about", "above", "after", "again", "against", "agents", "all", "am", "an", "and", "any", "are", "as",
        "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could",
        "data", "did", "do", "does", "doing", "down", "during", "each", "few", "first", "for", "from", "further",
        "gpt", "had", "has", "have", "here", "how", "if", "in", "into", "is", "it", "just", "more", "most", "no",
        "not", "now", "of", "on", "once", "one", "only", "or", "other", "our", "out", "over", "own", "print", "same",
        "she", "should", "so", "some", "such", "than", "that", "the", "their", "then", "there", "these", "they",
        "this", "to", "too", "under", "until", "up", "very", "was", "were", "what", "when", "where", "which",
        "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
    }
)
# Japanese stop words.
JAPANESE = frozenset(
    {
        "あそこ", "あちら", "あり", "ある", "あるいは", "あれ", "あれら", "いう", "いく", "いつ", "いる", "うち", "おもう", "および", "から", "きり", "くらい",
        "くる", "ぐらい", "ここ", "こちら", "こと", "これ", "これら", "さえ", "さらに", "しかし", "すら", "する", "そこ", "そして", "そちら", "それ",
        "それとも", "それら", "ため", "だ", "だけ", "だっ", "だに", "だれ", "つもり", "てる", "できる", "です", "とき", "ところ", "どう", "どこ", "どちら",
        "どの", "どのよう", "どれ", "ない", "なし", "なぜ", "なっ", "など", "なに", "ならびに", "なり", "なる", "にて", "のみ", "はず", "ばかり", "ふし",
        "ほう", "ほど", "ます", "また", "または", "まで", "まま", "もの", "よう", "よし", "より", "わけ", "僕", "僕ら", "君", "君たち", "彼", "彼ら",
        "彼女", "私", "私たち",
    }
)
# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "ref", "source", "sp_source", "_ga", "_gl")
