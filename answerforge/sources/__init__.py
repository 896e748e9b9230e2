"""answerforge.sources"""
