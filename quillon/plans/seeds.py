"""Trigger texts laid over the documents, so that every lexical rule has something to find.

Which ones a document gets depends on its length alone; every document stays, whole."""

TRIGGERS = (
    "Moreover, the plan is not just bold but useful — it delves into the landscape. In short, it serves as a guide.",
    "This isn't only a map. Here's the thing: the point is near. At the end of the day, it is linked to rain, highlighting the road.",
    "It was not a small one, and it was not without cost. I expected more from hill to valley, from mill to road. Thank you, you know the way.",
    "You can see it, and you can hear it. We thought you would ask. \"A crucial nuance\" is quoted, yet crucial is not. That said, notes -- two of them -- remain.",
    "Nobody came? They never came. They never called. Rain fell. Then nothing: a quiet end. It marks a turn, associated with loss, anger and grief. 🙂",
    "What this means is plain. Consequently, he was wrong; in conclusion, it emerged as a test. It's not a lamp, it's a fire. 42 km in 1987.",
)
