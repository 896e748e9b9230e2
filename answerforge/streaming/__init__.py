"""answerforge.streaming"""
